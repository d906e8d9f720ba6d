"""Recommenders as joins and aggregations.

A recommender yields a score table: query columns, ``candidate``, ``score``.
It is sparse: a training domain without a row scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from clickpath.functions.columns import similarity_norm, support_score
from clickpath.runtime import stored
from clickpath.schema import DOMAIN, SESSION, STEP

SESSION_BLOCK = 1_000
#: Domains at most in a dense tile. Only what is in every few sessions meets itself often enough for one.
HEAVY = 256
#: Rows, and pairs, that a task holds in its hash table at most: as many tasks as the table asks for, whatever its bytes.
ROWS_AT_ONCE = 1 << 20
PAIRS_AT_ONCE = 1 << 21


def support(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def popularity(train: DataFrame, top_n: int = 10) -> DataFrame:
    """(candidate, n, score): the top_n domains by n/(n+1), ties by name."""
    counts = support(train, [DOMAIN]).withColumnRenamed(DOMAIN, "candidate")
    top = counts.orderBy(F.col("n").desc(), "candidate").limit(top_n)
    return top.withColumn("score", support_score(F.col("n")))


def session_popular_scores(sessions: DataFrame, popular: DataFrame) -> DataFrame:
    """Per step: visits of a domain earlier in the session plus its popularity.

    The popular list is the recommender's own top_n and the visited list is a
    part of one bounded session, so both ride along as short arrays. Scores are
    rounded to 9 digits: equal ones tie in whatever order they were summed.
    """
    earlier = (Window.partitionBy(*SESSION).orderBy("pos")
               .rowsBetween(Window.unboundedPreceding, -1))
    listed = popular.agg(F.collect_list(F.struct("candidate", "score"))).scalar()
    visited = F.transform(
        F.col("_visited"), lambda d: F.struct(d.alias("candidate"), F.lit(1.0).alias("score")))
    return (
        sessions.withColumn("_visited", F.collect_list(DOMAIN).over(earlier))
        .where(F.size("_visited") > 0)
        .select(*STEP, F.inline(F.concat(visited, listed)))
        .groupBy(*STEP, "candidate").agg(F.round(F.sum("score"), 9).alias("score"))
    )


def session_visits(baskets: DataFrame, session: list[str]) -> DataFrame:
    """(session, domain, n), stored: co-occurrence reads it on both sides of a
    self-join, the domain supports are sums over it.

    Hardly any two rows are equal, so the rows themselves are dealt out, not
    each scan task's table of them.
    """
    return stored(support(_dealt(baskets.select(*session, DOMAIN), [*session, DOMAIN]), [*session, DOMAIN]), "visits")


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df by its keys, in tasks of about ROWS_AT_ONCE rows."""
    return df.repartition(_tasks(df.count(), ROWS_AT_ONCE), *keys)


def _tasks(n: int | None, at_once: int) -> int:
    return max(1, -(-(n or 0) // at_once))


def cooccurrence(baskets: DataFrame, session: list[str], block: int = SESSION_BLOCK) -> DataFrame:
    """(domain, other, n): every event of ``domain`` counts each different
    ``other`` of its session once, so n is not symmetric.

    Rows are reduced to one per session and domain before the self-join. A
    session of more than ``block`` domains is cut into blocks of about that
    many, and each pair of blocks is joined apart: no task holds a whole long
    session, no pair is lost. The number of pairs, known from the sessions'
    lengths, gives the number of tasks.
    """
    return _pair_counts(session_visits(baskets, session), session, block)


def _pair_counts(visits: DataFrame, session: list[str], block: int = SESSION_BLOCK,
                 wanted: Column | None = None) -> DataFrame:
    """Counts of pairs; ``wanted`` chooses by further columns of visits, those of ``other`` named o_*."""
    more = [c for c in visits.columns if c not in (*session, DOMAIN, "n")]
    lengths = (_dealt(visits.select(*session), session).groupBy(*session)
               .agg(F.count(F.lit(1)).alias("_length")))
    squares, longest = lengths.agg(F.sum(F.col("_length") * F.col("_length")), F.max("_length")).first()
    tasks = _tasks(squares, PAIRS_AT_ONCE)
    keys, cut = session, visits
    if longest and longest > block:
        long = (lengths.where(F.col("_length") > block)
                .select(*session, F.ceil(F.col("_length") / block).alias("_blocks")))
        cut = (visits.join(long, session, "left")
               .withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("bigint")))
               .withColumn("_own", F.pmod(F.xxhash64(DOMAIN), "_blocks")))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
        keys = [*session, "_a", "_b"]
    own_place = [] if cut is visits else [F.col("_own").alias("_a"), every.alias("_b")]
    other_place = [] if cut is visits else [every.alias("_a"), F.col("_own").alias("_b")]
    own = cut.select(*session, DOMAIN, "n", *more, *own_place)
    others = cut.select(*session, F.col(DOMAIN).alias("other"), *[F.col(c).alias(f"o_{c}") for c in more], *other_place)
    pairs = (own.repartition(tasks, *keys).join(others.repartition(tasks, *keys), keys)
             .where(F.col(DOMAIN) != F.col("other")))
    return (
        (pairs if wanted is None else pairs.where(wanted))
        .groupBy(DOMAIN, "other").agg(F.sum("n").alias("n"))
    )


def item_knn(baskets: DataFrame, session: list[str], n_sims: int = 100, lmbd: float = 20,
             alpha: float = 0.5, heavy: int = HEAVY) -> DataFrame:
    """(domain, other, sim): the n_sims most similar others of each domain.

    A product of sparse matrices in tiles, with a threshold. Domains with at
    least one ``heavy``-th of all visits, ``heavy`` at most, are counted against
    each other in one dense tile per task. The n_sims-th best of a heavy
    domain's similarities among these bounds what its list can still take: of
    its pairs with light domains, those whose supports allow no more are never
    made (see ``knn_counts``).
    """
    visits = session_visits(baskets, session)
    counts, sizes = knn_counts(visits, session, n_sims, lmbd, alpha, heavy)
    scored = (
        counts.join(sizes.select(DOMAIN, F.col("size").alias("n_domain")), DOMAIN)
        .join(sizes.select(F.col(DOMAIN).alias("other"), F.col("size").alias("n_other")), "other")
        .select(DOMAIN, "other", (F.col("n") / similarity_norm(
            F.col("n_domain"), F.col("n_other"), lmbd, alpha)).alias("sim"))
    )
    place = Window.partitionBy(DOMAIN).orderBy(F.col("sim").desc(), "other")
    return (scored.withColumn("_place", F.row_number().over(place))
            .where(F.col("_place") <= n_sims).drop("_place"))


def knn_counts(visits: DataFrame, session: list[str], n_sims: int, lmbd: float, alpha: float,
               heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Co-occurrence counts (domain, other, n) without those that cannot reach a list, and (domain, size, ...).

    A pair's count is at most the domain's size, and at most the sessions of
    the other times the domain's visits in any one session.
    """
    sizes = visits.groupBy(DOMAIN).agg(
        F.sum("n").alias("size"), F.count(F.lit(1)).alias("sessions"), F.max("n").alias("most"))
    total = sizes.agg(F.sum("size")).scalar()
    sizes = stored(sizes.withColumn("heavy", F.col("size") * heavy >= total), "sizes")
    names = [r[0] for r in sizes.where("heavy").select(DOMAIN).orderBy(DOMAIN).collect()]  # ``heavy`` at most
    dense = _heavy_counts(visits, session, names)
    if dense is None:
        return _pair_counts(visits, session), sizes
    dense = stored(dense, "heavy-pairs")
    of = sizes.select(DOMAIN, "size")
    place = Window.partitionBy(DOMAIN).orderBy(F.col("sim").desc())
    floors = (
        dense.join(of, DOMAIN).join(of.select(F.col(DOMAIN).alias("other"), F.col("size").alias("_other")), "other")
        .select(DOMAIN, (F.col("n") / similarity_norm(F.col("size"), F.col("_other"), lmbd, alpha)).alias("sim"))
        .withColumn("_place", F.row_number().over(place)).where(F.col("_place") == n_sims)
        .select(DOMAIN, F.col("sim").alias("floor")))
    if sizes.where("NOT heavy").isEmpty():
        return dense, sizes
    # the two factors of similarity_norm, once per domain
    known = (sizes.join(floors, DOMAIN, "left")
             .withColumn("as_own", F.pow(F.col("size") + lmbd, F.lit(float(alpha))))
             .withColumn("as_other", F.pow(F.col("size") + lmbd, F.lit(1.0 - alpha))))
    bound = F.least(F.col("size"), F.col("most") * F.col("o_sessions")) / (F.col("as_own") * F.col("o_as_other"))
    wanted = ~(F.col("heavy") & F.col("o_heavy")) & (
        F.col("floor").isNull() | (bound * (1 + 1e-9) >= F.col("floor")))
    rest = _pair_counts(visits.join(known, DOMAIN), session, wanted=wanted)
    return dense.unionByName(rest), sizes


def _heavy_counts(visits: DataFrame, session: list[str], names: list) -> DataFrame | None:
    """(domain, other, n) among these domains, from a dense tile per task of whole sessions; None if there is no pair."""
    if len(names) < 2:
        return None
    place = {name: i for i, name in enumerate(names)}
    index = visits.sparkSession.createDataFrame(
        list(place.items()), StructType([visits.schema[DOMAIN], StructField("i", IntegerType())]))
    lists = (visits.join(F.broadcast(index), DOMAIN).groupBy(*session)
             .agg(F.collect_list("i").alias("i"), F.collect_list("n").alias("n")).where(F.size("i") > 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = np.zeros((len(names), len(names)), np.int64)
        for batch in batches:
            at, n = (np.asarray(batch.column(c).flatten()) for c in ("i", "n"))
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column("i"))))
            for begin, end in zip(np.r_[0, ends[:-1]], ends):
                own = at[begin:end]
                tile[np.ix_(own, own)] += n[begin:end, None]
        np.fill_diagonal(tile, 0)
        a, b = np.nonzero(tile)
        for k in range(0, len(a), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_pydict({"a": a[part].astype(np.int32), "b": b[part].astype(np.int32),
                                              "n": tile[a[part], b[part]]})

    sums = lists.select("i", "n").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return (sums.join(F.broadcast(index.withColumnRenamed("i", "a")), "a")
            .join(F.broadcast(index.select(F.col(DOMAIN).alias("other"), F.col("i").alias("b"))), "b")
            .select(DOMAIN, "other", "n"))


def neighbour_lists(sims: DataFrame) -> DataFrame:
    """The similarity table as a score table with the query column ``prev``."""
    return sims.select(F.col(DOMAIN).alias("prev"), F.col("other").alias("candidate"),
                       F.col("sim").alias("score"))


def knn_scores(steps: DataFrame, sims: DataFrame) -> DataFrame:
    """Per step: the neighbours of its previous domain."""
    return steps.select(*STEP, "prev").join(neighbour_lists(sims), "prev").select(
        *STEP, "candidate", "score")


def recommend(scores: DataFrame, k: int, query: list[str] = STEP) -> DataFrame:
    """The k best candidates of each query, best first."""
    return _best(scores, k, query)


def recommend_by_kind(scores: DataFrame, vocab: DataFrame, k: int, query: list[str] = STEP) -> DataFrame:
    """The k best merchants and the k best publishers of each query."""
    kinds = vocab.select(F.col(DOMAIN).alias("candidate"), "is_merchant")
    return _best(scores.join(kinds, "candidate"), k, [*query, "is_merchant"])


def _best(scores: DataFrame, k: int, groups: list[str]) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.col("score").desc(), "candidate")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def restrict_to_known(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose domain occurs in training."""
    return test.join(train.select(DOMAIN).distinct(), DOMAIN, "left_semi")


def with_start(sessions: DataFrame) -> DataFrame:
    """Adds ``start_sec``, the time of a session's first event."""
    return sessions.withColumn("start_sec", F.min("sec").over(Window.partitionBy(*SESSION)))


def split_by_start(sessions: DataFrame, at: int | Column) -> tuple[DataFrame, DataFrame]:
    """Train: sessions that start before ``at`` (seconds); test: the others.

    Plain filters, so a stored table's scan takes them over.
    """
    start = F.col("start_sec")
    return sessions.where(start < at).drop("start_sec"), sessions.where(start >= at).drop("start_sec")


def with_side(sessions: DataFrame, at: int | Column) -> DataFrame:
    """Adds ``side``, 'train' or 'test', by the same rule as split_by_start."""
    return sessions.withColumn("side", F.when(F.col("start_sec") < at, "train").otherwise("test"))


def split_tail(sessions: DataFrame, numbered: DataFrame, n_test: int,
               n_gap: int = 0) -> tuple[DataFrame, DataFrame]:
    """Test: the last n_test sessions by number; train: all but the last
    n_test + n_gap."""
    last = numbered.agg(F.max("session_id")).scalar()
    placed = sessions.join(numbered, SESSION)
    from_end = last - F.col("session_id")
    return placed.where(from_end >= n_test + n_gap), placed.where(from_end < n_test)
