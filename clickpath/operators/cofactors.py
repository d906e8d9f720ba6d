"""Domain vectors by factorising co-occurrence: no vocabulary on the driver.

Pairs of domains close to each other in sessions, weighted by their positive
pointwise mutual information, form a symmetric sparse matrix M. A randomised
block power iteration finds its leading eigenvectors: a block Q of random
columns, a row per domain, is multiplied by M (a join and a sum per domain) and
made orthonormal again through its small Gram matrix. Only ``size`` x ``size``
numbers reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from clickpath.operators.factors import gram
from clickpath.runtime import stored
from clickpath.schema import DOMAIN, SESSION


def window_pairs(sessions: DataFrame, window: int = 3) -> DataFrame:
    """(domain, context, n): how often context lies up to ``window`` rows beside domain in a session; symmetric."""
    by_pos = Window.partitionBy(*SESSION).orderBy("pos")
    following = F.array(*[F.lead(DOMAIN, k).over(by_pos) for k in range(1, window + 1)])
    ahead = (sessions.select(DOMAIN, following.alias("_beside"))
             .select(DOMAIN, F.explode(F.array_compact("_beside")).alias("context"))
             .groupBy(DOMAIN, "context").agg(F.count(F.lit(1)).alias("n")))
    behind = ahead.select(F.col("context").alias(DOMAIN), F.col(DOMAIN).alias("context"), "n")
    return ahead.unionByName(behind).groupBy(DOMAIN, "context").agg(F.sum("n").alias("n"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """(domain, context, value): ln(n * all / (n of domain * n of context)) where it is positive."""
    sums = pairs.groupBy(DOMAIN).agg(F.sum("n").alias("own"))
    total = sums.agg(F.sum("own")).scalar()
    value = F.log(F.col("n").cast("double") * total / (F.col("own") * F.col("beside").cast("double")))
    return (pairs.join(sums, DOMAIN).join(sums.select(F.col(DOMAIN).alias("context"), F.col("own").alias("beside")), "context")
            .select(DOMAIN, "context", value.alias("value")).where(F.col("value") > 0))


def _times(matrix: DataFrame, block: DataFrame) -> DataFrame:
    """M Q as (domain, vec); one running sum per domain and task is shuffled, not the vectors of all pairs."""
    columns = block.select(F.col(DOMAIN).alias("context"), array_to_vector("vec").alias("_v"))
    return (matrix.join(columns, "context").groupBy(DOMAIN)
            .agg(vector_to_array(Summarizer.sum(F.col("_v"), F.col("value"))).alias("vec")))


def _turned(block: DataFrame, by: np.ndarray) -> DataFrame:
    """Every vector times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("vec").flatten()).reshape(-1, by.shape[0]) @ by
            yield pa.RecordBatch.from_pydict({
                DOMAIN: batch.column(DOMAIN), "vec": pa.array(list(rows), pa.list_(pa.float64()))})

    return block.select(DOMAIN, "vec").mapInArrow(run, "domain string, vec array<double>")


def _drawn(domains: DataFrame, size: int, seed: int) -> DataFrame:
    """Normal random vectors that the seed and each domain's name fix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(DOMAIN).to_pylist()
            keys = [int.from_bytes(hashlib.sha256(f"{seed}|{n}".encode()).digest()[:8], "big") for n in names]
            rows = [np.random.default_rng(k).normal(size=size) for k in keys]
            yield pa.RecordBatch.from_pydict({DOMAIN: batch.column(DOMAIN), "vec": pa.array(rows, pa.list_(pa.float64()))})

    return domains.select(DOMAIN).mapInArrow(run, "domain string, vec array<double>")


def _orthonormal(block: DataFrame, size: int) -> DataFrame:
    """The block with orthonormal columns; directions that it does not have become zero."""
    values, axes = np.linalg.eigh(gram(block, size))
    kept = values > 1e-12 * max(values.max(), 1e-300)
    return _turned(block, axes * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0))


def pair_factors(matrix: DataFrame, size: int = 50, rounds: int = 5, seed: int = 1) -> DataFrame:
    """(domain, vec): leading eigenvectors of a symmetric (domain, context, value), scaled by the root of |eigenvalue|.

    The same seed gives the same vectors, up to rounding. Domains without a
    pair have no vector; an empty matrix gives none.
    """
    matrix = stored(matrix, "pairs")
    block = _drawn(matrix.select(DOMAIN).distinct(), size, seed)
    for _ in range(rounds):
        block = stored(_orthonormal(stored(_times(matrix, block), "product"), size), "block")
    product = _times(matrix, block)
    both = block.join(product.withColumnRenamed("vec", "_y"), DOMAIN).select(F.concat("vec", "_y").alias("vec"))
    small = gram(both, 2 * size)[:size, size:]  # Q'MQ beside Q'Q
    values, axes = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values))
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(size)])
    return _turned(block, axes * np.sqrt(np.abs(values[order])))
