"""Learned vectors and factors, and the tables that training reads."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickpath.functions.columns import seeded_number, seeded_residue
from clickpath.operators.factors import alternated, sharded
from clickpath.operators.numbering import dense_index, index_column, number_sessions
from clickpath.operators.scoring import random_scorer, top_scores
from clickpath.operators.vectors import lookup_vector
from clickpath.runtime import stored
from clickpath.schema import DOMAIN, SESSION, STEP

# Fixed value: the token closing a session in the corpus, three times
STOP = ["UNK", "UNK", "UNK"]


def word2vec_corpus(sessions: DataFrame) -> DataFrame:
    """(guid, session_no, tokens): domains in order, then the stop tokens."""
    visited = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", DOMAIN))), lambda e: e[DOMAIN])
    return sessions.groupBy(*SESSION).agg(
        F.concat(visited, F.array(*[F.lit(t) for t in STOP])).alias("tokens"))


def domain_vectors(corpus: DataFrame, size: int = 50, iterations: int = 50, window: int = 3,
                   seed: int = 1, partitions: int | None = None) -> DataFrame:
    """(domain, vec) by skip-gram; the corpus is trained in ``partitions`` parts."""
    parts = partitions or corpus.sparkSession.sparkContext.defaultParallelism
    model = Word2Vec(vectorSize=size, minCount=1, maxIter=iterations, windowSize=window,
                     numPartitions=parts, seed=seed, inputCol="tokens", outputCol="vec").fit(corpus)
    return model.getVectors().select(
        F.col("word").alias(DOMAIN), vector_to_array("vector").alias("vec"))


def item_factors(train: DataFrame, factors: int = 100, iterations: int = 10, seed: int = 1) -> DataFrame:
    """(domain, vec): implicit-feedback factors of the domains by ALS.

    Spark draws the first factors and makes the first round; the others, the
    same least squares, solve a session by a system as large as it has domains.
    """
    domains = index_column(train, DOMAIN, "item")
    sessions = number_sessions(train, first=0, name="session")
    visits, wanted, shards = sharded(
        train.groupBy(*SESSION, DOMAIN).agg(F.count(F.lit(1)).cast("float").alias("n"))
        .join(domains, DOMAIN).join(sessions, SESSION)
        .select(F.col("session").cast("int"), F.col("item").cast("int"), "n")
    )
    # nothing is kept at the end, so the sessions' own step after the first round is never run
    first = ALS(rank=factors, maxIter=min(iterations, 1), implicitPrefs=True, seed=seed, finalStorageLevel="NONE",
                userCol="session", itemCol="item", ratingCol="n").fit(visits.drop("_shard"))
    items = stored(first.itemFactors.select(F.col("id").alias("item"), F.col("features").alias("vec")), "factors")
    for _ in range(iterations - 1):
        items = alternated(visits, wanted, shards, items, factors)
    return items.join(domains, "item").select(DOMAIN, F.col("vec").cast("array<double>").alias("vec"))


def random_scores(steps: DataFrame, vocab: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The k best of uniform random scores over all domains, per step."""
    return top_scores(*random_sides(steps, vocab, seed), random_scorer, k)


def random_sides(steps: DataFrame, vocab: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Steps and domains with the residues the random scorer multiplies."""
    drawn = steps.withColumn("query", seeded_residue(seed, *[F.col(c) for c in STEP]))
    return drawn, vocab.select("idx", DOMAIN, seeded_residue(seed, F.col(DOMAIN)).alias("item"),
                               F.lit(0.0).alias("bias"))


def negative_samples(rows: DataFrame, seed: int = 0, pool: str = "all") -> DataFrame:
    """(guid, session_no, pos, positive, negative): each row with the domain of
    a row drawn uniformly from all rows.

    ``pool='head'`` draws from the first rows only, as many as there are domains.
    """
    numbered = dense_index(rows.select(*STEP, DOMAIN), STEP, "row_no")
    counted = F.count(F.lit(1)) if pool == "all" else F.count_distinct(DOMAIN)
    size = numbered.agg(counted).scalar()
    drawn = numbered.select(
        *STEP, F.col(DOMAIN).alias("positive"),
        (seeded_number(seed, *[F.col(c) for c in STEP]) % size).alias("row_no"))
    pool_rows = numbered.where(F.col("row_no") < size).select("row_no", F.col(DOMAIN).alias("negative"))
    return drawn.join(pool_rows, "row_no").drop("row_no")


def training_examples(runs: DataFrame, vectors: DataFrame, prior: Column, vocab: DataFrame) -> DataFrame:
    """One row per prediction: input vector (domain vector, then context), the
    target with its index and flags, and the target's context. The index of a
    target outside the vocabulary is null.

    ``runs`` are steps with ``context``, ``pos`` and ``is_merchant``.
    """
    by_pos = Window.partitionBy(*SESSION).orderBy("pos")
    visit = F.row_number().over(Window.partitionBy(*SESSION, DOMAIN).orderBy("pos"))
    index = vocab.select(F.col(DOMAIN).alias("target"), F.col("idx").alias("target_idx"))
    steps = (
        lookup_vector(runs, vectors, prior)
        .withColumn("_seen", (visit > 1).cast("int"))
        .select(
            *STEP,
            F.concat("vec", "context").alias("input_vec"),
            F.lead(DOMAIN).over(by_pos).alias("target"),
            F.lead("is_merchant").over(by_pos).alias("target_is_merchant"),
            F.lead("_seen").over(by_pos).alias("seen_before"),
            F.lead("context").over(by_pos).alias("next_context"),
        )
        .where(F.col("target").isNotNull())
    )
    return steps.join(index, "target", "left")
