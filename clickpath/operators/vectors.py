"""Vector lookups and means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from clickpath.schema import RUN, SESSION

WORD_BLOCK = 65_536
WORD_SHARD = 50_000
SUMMED_AT_ONCE = 10_000


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec", weight: str | None = None) -> DataFrame:
    """Mean of an array column per key.

    One running mean per key and task reaches the shuffle, not the vectors.
    """
    as_vector = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    mean = (Summarizer.mean(F.col("_v")) if weight is None
            else Summarizer.mean(F.col("_v"), F.col(weight).cast("double")))
    return as_vector.groupBy(*keys).agg(vector_to_array(mean).alias("vec"))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def merchant_prior(merchants: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: the mean vector of the merchants that have one."""
    known = vectors.join(merchants.select("domain"), "domain", "left_semi")
    return mean_vectors(known, [])


def lookup_vector(df: DataFrame, vectors: DataFrame, prior: Column, on: str = "domain",
                  name: str = "vec") -> DataFrame:
    """Adds the vector of each row's key, the prior where it has none."""
    table = vectors.select(F.col("domain").alias(on), F.col("vec").cast("array<double>").alias("_known"))
    return (df.join(table, on, "left")
            .withColumn(name, F.coalesce("_known", prior)).drop("_known"))


def domain_keyword_mean(words_of_domain: DataFrame, keyword_vectors: DataFrame, dim: int) -> DataFrame:
    """(domain, vec): mean over a domain's distinct known words, zeros if none."""
    known = mean_vectors(words_of_domain.join(keyword_vectors, "word"), ["domain"])
    return (words_of_domain.select("domain").distinct().join(known, "domain", "left")
            .select("domain", F.coalesce("vec", zero_vector(dim)).alias("vec")))


def word_sums(rows: DataFrame, keys: list[str], words: str, vectors: DataFrame, block: int = WORD_BLOCK,
              shard_rows: int = WORD_SHARD) -> DataFrame:
    """(keys, n, sum): how many occurrences in the array ``words`` have a vector, and the sum of these.

    A sparse matrix times the vectors, in tiles: occurrences, narrow rows, meet a
    block of about ``block`` words' vectors, and one sum per key and block leaves
    the task, whatever the number of words. Frequent words are spread over
    shards of keys with about ``shard_rows`` occurrences; a shard is sent the
    vectors of the words that it has, no others. Rows of equal keys are one row.
    Keys without a known word have no row.
    """
    blocks = vectors.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block))).scalar().cast("bigint")
    shards = rows.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size(words)) / shard_rows))).scalar().cast("bigint")
    left = (rows.select(*keys, F.explode(words).alias("word"))
            .withColumn("_block", F.pmod(F.xxhash64("word"), blocks))
            .withColumn("_shard", F.pmod(F.xxhash64(*keys), shards)))
    wanted = left.select(F.col("_shard").alias("_to"), F.col("_block").alias("_of"), F.col("word").alias("_wanted")).distinct()
    right = (vectors.select("word", F.col("vec").cast("array<double>").alias("vec"))
             .join(wanted, F.col("word").eqNullSafe(F.col("_wanted")))
             .select("word", "vec", F.col("_to").alias("_shard"), F.col("_of").alias("_block")))

    def product(found: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        at = pd.Index(known["word"]).get_indexer(found["word"])
        found, at = found[at >= 0], at[at >= 0]
        if not len(found):
            return pd.DataFrame(columns=[*keys, "n", "sum"])
        matrix = np.stack(known["vec"].to_numpy())
        groups = found.groupby(keys, sort=False, dropna=False)
        group = groups.ngroup().to_numpy()
        sums = np.zeros((groups.ngroups, matrix.shape[1]))
        for k in range(0, len(at), SUMMED_AT_ONCE):
            np.add.at(sums, group[k:k + SUMMED_AT_ONCE], matrix[at[k:k + SUMMED_AT_ONCE]])
        return groups.size().reset_index(name="n").assign(sum=list(sums))

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    parts = (left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block"))
             .applyInPandas(product, f"{fields}, n bigint, sum array<double>"))
    total = Summarizer.sum(array_to_vector("sum"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), vector_to_array(total).alias("sum"))


def run_keyword_mean(runs: DataFrame, keyword_vectors: DataFrame, domain_means: DataFrame, dim: int,
                     fallback: str = "domain") -> DataFrame:
    """Adds ``kw_vec`` to every run: the mean over its known word occurrences.

    A run without known words takes its domain's mean (fallback 'domain') or
    zeros (fallback 'zeros').
    """
    own = word_sums(runs, RUN, "keywords", keyword_vectors).select(
        *RUN, F.transform("sum", lambda x: x / F.col("n")).alias("_own"))
    joined = runs.join(own, RUN, "left")
    if fallback == "domain":
        joined = joined.join(domain_means.withColumnRenamed("vec", "_domain"), "domain", "left")
        return joined.withColumn("kw_vec", F.coalesce("_own", "_domain", zero_vector(dim))).drop("_own", "_domain")
    return joined.withColumn("kw_vec", F.coalesce("_own", zero_vector(dim))).drop("_own")


def session_vector(sessions: DataFrame, vec: str = "vec", name: str = "session_vec") -> DataFrame:
    """Mean of the vectors visited so far, this row and repeats included.

    A prefix-sum scan: a session's rows pass in order through one task, which
    holds the running sum, so the work is linear in the session's length. A row
    without a vector adds nothing; before the first one the mean is null.
    """
    kept = [c for c in sessions.columns if c not in (vec, name)]
    carried = sessions.select(*kept, F.col(vec).cast("array<double>").alias(vec))
    ordered = carried.repartition(*SESSION).sortWithinPartitions(*SESSION, "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, seen = None, None, 0
        for batch in batches:
            given = batch.column(vec)
            there = np.asarray(given.is_valid())
            rows = np.asarray(given.flatten())
            rows = rows.reshape(int(there.sum()), -1) if there.any() else rows.reshape(0, 0)
            at = np.cumsum(there)  # of the rows before and with each, how many have a vector
            means: list[np.ndarray | None] = []
            sessions_ = list(zip(*(batch.column(c).to_pylist() for c in SESSION)))
            begin = 0
            while begin < len(sessions_):
                end = begin + 1
                while end < len(sessions_) and sessions_[end] == sessions_[begin]:
                    end += 1
                if sessions_[begin] != now:
                    now, total, seen = sessions_[begin], None, 0
                first = at[begin] - there[begin]
                own = rows[first:at[end - 1]]
                if total is not None and len(own):
                    own = np.concatenate([total[None], own])
                sums = np.cumsum(own, axis=0)[int(total is not None):] if len(own) else own
                counts = seen + np.arange(1, len(sums) + 1)
                own_means = sums / counts[:, None] if len(sums) else sums
                before = total / seen if total is not None else None
                for i in range(begin, end):
                    k = at[i] - first
                    means.append(own_means[k - 1] if k else before)
                if len(sums):
                    total, seen = sums[-1], int(counts[-1])
                begin = end
            out = {c: batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict(out | {name: pa.array(means, pa.list_(pa.float64()))})

    fields = StructType([*ordered.schema.fields, StructField(name, ArrayType(DoubleType()))])
    return ordered.mapInArrow(run, fields).select(*[c for c in sessions.columns if c != name], name)


def long_form(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """One row per vector element."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "value"))
