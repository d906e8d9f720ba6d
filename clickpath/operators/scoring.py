"""Models that score every training domain at every step.

The score matrix (steps x domains) is never written out. Steps are cut into
shards and domains into blocks; each (shard, block) pair is one task-sized
matrix product, of which only the k best or the count above the target leave
the task. No side is broadcast. The number of shards follows from the number
of steps, so a task stays as large at any data size.

Blocks hold domains of falling norm. No score in a block exceeds the step's
norm times the block's largest, plus its largest bias (Cauchy-Schwarz), so a
step only meets the blocks that may reach the score it has to beat: its own
target's, or the k-th best of the first block. What is left out cannot count.

A matrix product may differ in the last bits from one block shape to another.
Scores that it finds close to each other are therefore worked out again by a
sum in fixed order, so that equal vectors tie whatever the tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from clickpath.functions.columns import PRIME, dot
from clickpath.operators.numbering import dense_index
from clickpath.operators.recommend import recommend
from clickpath.runtime import stored
from clickpath.schema import STEP

BLOCK = 65_536
SHARD_ROWS = 50_000
CELLS_AT_ONCE = 1 << 22


class DotScorer:
    """Session vector times item vector, plus the item's bias."""

    def sides(self, steps: pd.DataFrame, items: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.stack(steps["query"].to_numpy()), np.stack(items["item"].to_numpy()), items["bias"].to_numpy()

    def product(self, queries: np.ndarray, items: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All scores, and by how much those of each step may be off."""
        scale = np.linalg.norm(queries, axis=1) * np.linalg.norm(items, axis=1).max() + np.abs(bias).max()
        return queries @ items.T + bias, 1e-12 * (1 + scale)

    def exact(self, queries: np.ndarray, items: np.ndarray, bias: np.ndarray, q: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Scores of the pairs (q, i), summed in the order of ``own``."""
        total = np.zeros(len(q))
        for d in range(queries.shape[1]):
            total += queries[q, d] * items[i, d]
        return total + bias[i]

    def own(self) -> Column:
        return dot(F.col("query"), F.col("item")) + F.col("bias")

    def size(self) -> Column:
        return F.sqrt(dot(F.col("item"), F.col("item")))

    def most(self, limit: Column) -> Column:
        """An upper bound of a step's scores in a block with these limits, rounding errors included."""
        reach = F.sqrt(dot(F.col("query"), F.col("query"))) * limit["size"]
        return reach + limit["bias"] + 1e-9 * (1 + reach + F.abs(limit["bias"]))


class RandomScorer:
    """Uniform in (0, 1), fixed by the step's and the item's seeded residues."""

    def sides(self, steps: pd.DataFrame, items: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return steps["query"].to_numpy(), items["item"].to_numpy(), items["bias"].to_numpy()

    def product(self, queries: np.ndarray, items: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return queries[:, None] * items[None, :] % PRIME / PRIME, np.zeros(len(queries))

    def exact(self, queries: np.ndarray, items: np.ndarray, bias: np.ndarray, q: np.ndarray, i: np.ndarray) -> np.ndarray:
        return queries[q] * items[i] % PRIME / PRIME

    def own(self) -> Column:
        return F.col("query") * F.col("item") % PRIME / PRIME

    def size(self) -> Column:
        return F.lit(1.0)

    def most(self, limit: Column) -> Column:
        return F.lit(1.0)


dot_scorer, random_scorer = DotScorer(), RandomScorer()
Scorer = DotScorer | RandomScorer


def in_blocks(items: DataFrame, scorer: Scorer, block: int = BLOCK) -> DataFrame:
    """items with ``_block`` and ``_size``, stored: blocks of falling size, numbered from 0."""
    sized = items.withColumn("_size", scorer.size())
    placed = dense_index(sized, [F.col("_size").desc(), F.col("idx")], "_place")
    return stored(placed.withColumn("_block", F.floor(F.col("_place") / block)).drop("_place"), "blocks")


def with_reach(steps: DataFrame, blocks: DataFrame, scorer: Scorer, floor: Column | None = None,
               first: int = 0, last: int | None = None) -> DataFrame:
    """steps with ``_blocks``: the blocks from ``first`` to ``last`` that may hold a score of ``floor`` or more.

    The blocks' limits, an entry per block of domains, ride along as an array.
    """
    chosen = blocks.where(F.col("_block") >= first) if last is None else blocks.where(
        F.col("_block").between(first, last))
    limits = (chosen.groupBy("_block").agg(F.max("_size").alias("size"), F.max("bias").alias("bias"))
              .agg(F.collect_list(F.struct("_block", "size", "bias"))).scalar())
    reached = steps.withColumn("_blocks", limits)
    if floor is not None:
        reached = reached.withColumn("_blocks", F.filter("_blocks", lambda b: scorer.most(b) >= floor))
    return reached.withColumn("_blocks", F.transform("_blocks", lambda b: b["_block"]))


def tiles(reached: DataFrame, blocks: DataFrame, shards: int | None = None):
    """Both sides keyed by (_shard, _block); blocks go to the shards with a step that reaches them."""
    count = F.lit(shards) if shards else reached.agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SHARD_ROWS))).scalar()
    left = (reached.withColumn("_shard", F.pmod(F.xxhash64(*STEP), count.cast("bigint")))
            .withColumn("_block", F.explode("_blocks")).drop("_blocks"))
    wanted = left.select(F.col("_shard").alias("_to"), F.col("_block").alias("_wanted")).distinct()
    right = (blocks.drop("_size").join(wanted, F.col("_block") == F.col("_wanted")).drop("_wanted")
             .withColumnRenamed("_to", "_shard"))
    return left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block"))


def block_share(reached: DataFrame, blocks: DataFrame) -> DataFrame:
    """(steps, blocks, met): of all pairs of a step and a block, those that were not left out."""
    n = blocks.agg(F.count_distinct("_block")).scalar()
    return reached.agg(F.count(F.lit(1)).alias("steps"), F.max(n).alias("blocks"), F.sum(F.size("_blocks")).alias("met"))


def key_schema(steps: DataFrame) -> str:
    return ", ".join(f"`{c}` {steps.schema[c].dataType.simpleString()}" for c in STEP)


def slices(left: pd.DataFrame, right: pd.DataFrame):
    """Parts of the steps whose scores fit in memory; none if there are no items."""
    if len(right):
        rows = max(1, CELLS_AT_ONCE // len(right))
        for at in range(0, len(left), rows):
            yield left.iloc[at:at + rows]


def top_scores(steps: DataFrame, items: DataFrame, scorer: Scorer, k: int,
               shards: int | None = None, block: int = BLOCK) -> DataFrame:
    """The k best domains of every step, ties by name: STEP, candidate, score, place.

    steps: STEP and ``query``; items: ``idx, domain, item, bias``. The first
    block gives k scores to beat; of the others a step meets those that can.
    """

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("domain")
        names = right["domain"].to_numpy()
        found = []
        for rows in slices(left, right):
            sides = scorer.sides(rows, right)
            scores, off = scorer.product(*sides)
            kth = np.partition(scores, len(names) - min(k, len(names)), axis=1)[:, len(names) - min(k, len(names))]
            q, i = np.nonzero(scores >= (kth - 2 * off)[:, None])
            exact = scorer.exact(*sides, q, i)
            order = np.lexsort((i, -exact, q))
            q, i, exact = q[order], i[order], exact[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < k
            found.append(rows[STEP].iloc[q[kept]].assign(candidate=names[i[kept]], score=exact[kept]))
        return pd.concat(found) if found else pd.DataFrame(columns=[*STEP, "candidate", "score"])

    schema = f"{key_schema(steps)}, candidate string, score double"
    asked, blocks = steps.select(*STEP, "query"), in_blocks(items, scorer, block)
    first = tiles(with_reach(asked, blocks, scorer, last=0), blocks, shards).applyInPandas(best, schema)
    if blocks.where("_block > 0").isEmpty():
        return recommend(first, k)
    first = stored(first, "first-block")
    kth = first.groupBy(*STEP).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_kth"))
    floored = asked.join(kth, STEP, "left").withColumn("_kth", F.coalesce("_kth", F.lit(float("-inf"))))
    rest = with_reach(floored, blocks, scorer, F.col("_kth"), first=1).drop("_kth")
    return recommend(first.unionByName(tiles(rest, blocks, shards).applyInPandas(best, schema)), k)


def with_own_score(steps: DataFrame, items: DataFrame, scorer: Scorer) -> DataFrame:
    """STEP, query, own_idx, own_score of the steps whose target is among the items."""
    own = items.select(F.col("domain").alias("target"), F.col("idx").alias("own_idx"), "item", "bias")
    return (steps.select(*STEP, "query", "target").join(own, "target")
            .select(*STEP, "query", "own_idx", scorer.own().alias("own_score")))


def dense_target_rank(steps: DataFrame, items: DataFrame, scorer: Scorer,
                      shards: int | None = None, block: int = BLOCK) -> DataFrame:
    """STEP and ``rank`` of the target among all domains, ties to the lower
    idx; null if the target is not among the items.

    steps: STEP, ``query`` and ``target``; items: ``idx, domain, item, bias``.
    """
    known = with_own_score(steps, items, scorer)

    def above(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        idx = right["idx"].to_numpy()
        counts = []
        for rows in slices(left, right):
            sides = scorer.sides(rows, right)
            scores, off = scorer.product(*sides)
            bar, own_idx = (rows[c].to_numpy() for c in ("own_score", "own_idx"))
            n = (scores > (bar + off)[:, None]).sum(axis=1)
            q, i = np.nonzero(np.abs(scores - bar[:, None]) <= off[:, None])
            exact = scorer.exact(*sides, q, i)
            before = (exact > bar[q]) | ((exact == bar[q]) & (idx[i] < own_idx[q]))
            n += np.bincount(q[before & (idx[i] != own_idx[q])], minlength=len(rows))
            counts.append(rows[STEP].assign(n=n))
        return pd.concat(counts) if counts else pd.DataFrame(columns=[*STEP, "n"])

    blocks = in_blocks(items, scorer, block)
    reached = with_reach(known, blocks, scorer, F.col("own_score"))
    counted = tiles(reached, blocks, shards).applyInPandas(above, f"{key_schema(steps)}, n bigint")
    ranks = counted.groupBy(*STEP).agg((F.sum("n") + 1).alias("rank"))
    return steps.select(*STEP).join(ranks, STEP, "left")


def vector_items(vocab: DataFrame, vectors: DataFrame, bias: Column | None = None) -> DataFrame:
    """Scoring side of a factor model: vocabulary entries that have a vector."""
    return vocab.join(vectors, "domain").select(
        "idx", "domain", F.col("vec").cast("array<double>").alias("item"),
        (F.lit(0.0) if bias is None else bias).alias("bias"))
