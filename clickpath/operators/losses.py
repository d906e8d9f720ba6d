"""Losses of dense models: every training domain has a score at every step.

Scores are made tile by tile, as for ranks, and never written. A tile sends a
few numbers per step: its largest score with the sum of exp(score - largest),
which merge into the log-sum-exp of all (a running maximum and a scaled sum);
counts of scores per bin, from which the n-th best follows; sums over those
above it. Scores may be negative. A step whose target is not among the items
has no score to compare with and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clickpath.operators.scoring import BLOCK, Scorer, in_blocks, key_schema, slices, tiles, with_own_score, with_reach
from clickpath.runtime import stored
from clickpath.schema import STEP

BINS = 64
LISTED = 512  # scores of one bin that are sent instead of being cut into further bins


def _per_tile(steps: DataFrame, blocks: DataFrame, scorer: Scorer, shards: int | None, summed, fields: str) -> DataFrame:
    """``summed(rows, scores)`` of every tile. Rows and domains are sorted, so a tile's scores are the same each time."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [f.split()[0] for f in fields.split(", ")]
        found = []
        right = right.sort_values("idx")
        for rows in slices(left.sort_values(STEP), right):
            scores, _ = scorer.product(*scorer.sides(rows, right))
            found.append(rows[STEP].assign(**dict(zip(names, summed(rows, scores)))))
        return pd.concat(found) if found else pd.DataFrame(columns=[*STEP, *names])

    reached = with_reach(steps, blocks, scorer)
    return tiles(reached, blocks, shards).applyInPandas(run, f"{key_schema(steps)}, {fields}")


def score_range(known: DataFrame, blocks: DataFrame, scorer: Scorer, shards: int | None = None) -> DataFrame:
    """known with ``top, low, n`` and ``mass``, the sum of exp(score - top) over all domains."""

    def summed(rows: pd.DataFrame, scores: np.ndarray) -> tuple:
        top = scores.max(axis=1)
        return top, scores.min(axis=1), np.full(len(rows), scores.shape[1]), np.exp(scores - top[:, None]).sum(axis=1)

    parts = _per_tile(known, blocks, scorer, shards, summed, "part_top double, low double, n long, part_mass double")
    merged = parts.groupBy(*STEP).agg(
        F.max("part_top").alias("top"), F.min("low").alias("low"), F.sum("n").alias("n"),
        F.collect_list(F.struct("part_top", "part_mass")).alias("_parts"))  # one per block of domains
    mass = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["part_mass"] * F.exp(p["part_top"] - F.col("top")))
    return known.join(merged.withColumn("mass", mass).drop("_parts"), STEP)


def _edges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = low[:, None] + (high - low)[:, None] * (np.arange(BINS + 1) / BINS)
    out[:, 0], out[:, -1] = low, high
    return out


def nth_best(ranged: DataFrame, blocks: DataFrame, scorer: Scorer, shards: int | None = None) -> DataFrame:
    """STEP and ``nth``: the score at place ``need`` of each step, the best being place 1.

    ranged: STEP, query, low, top, need. Scores from low to top are counted in
    bins and the bin with the place is cut again, until it holds so few scores
    that they are sent, or one number only. A round divides the width by BINS,
    so the doubles between two bounds end in about ten, mostly in one or two.
    """
    keys = key_schema(ranged)
    kept = [*STEP, "query"]

    def counted(rows: pd.DataFrame, scores: np.ndarray) -> tuple:
        low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
        edges = _edges(low, high)
        inside = (scores >= low[:, None]) & (scores < high[:, None])
        with np.errstate(invalid="ignore", divide="ignore"):
            at = np.nan_to_num((scores - low[:, None]) / (high - low)[:, None] * BINS)
        at = np.clip(at, 0, BINS - 1).astype(np.int64)
        row = np.arange(len(rows))[:, None]
        at -= scores < edges[row, at]  # the division may miss an edge by a rounding error
        at = np.clip(at, 0, BINS - 1)
        at += scores >= edges[row, at + 1]
        flat = (row * BINS + np.clip(at, 0, BINS - 1))[inside]
        return (list(np.bincount(flat, minlength=len(rows) * BINS).reshape(len(rows), BINS)),)

    def narrowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            counts = np.stack(rows["counts"].to_numpy())
            through = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # scores in this bin or above
            need = rows["need"].to_numpy()
            chosen = np.maximum((through >= need[:, None]).sum(axis=1) - 1, 0)
            each = np.arange(len(rows))
            edges = _edges(rows["low"].to_numpy(), rows["high"].to_numpy())
            yield rows[kept].assign(
                low=edges[each, chosen], high=edges[each, chosen + 1],
                need=need - (through[each, chosen] - counts[each, chosen]), inside=counts[each, chosen])

    def listed(rows: pd.DataFrame, scores: np.ndarray) -> tuple:
        own = (scores >= rows["low"].to_numpy()[:, None]) & (scores < rows["high"].to_numpy()[:, None])
        return ([s[o] for s, o in zip(scores, own)],)

    open_ = ranged.select(*kept, "low", (F.col("top") + 1e-9 * (1 + F.abs("top"))).alias("high"),
                          F.col("need").cast("long").alias("need"), F.lit(LISTED + 1).cast("long").alias("inside"))
    found = []
    while True:
        bins = _per_tile(open_, blocks, scorer, shards, counted, "counts array<long>")
        bins = bins.groupBy(*STEP).agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(BINS)]).alias("counts"))
        query = ranged.schema["query"].dataType.simpleString()
        state = stored(open_.drop("inside").join(bins, STEP).mapInPandas(
            narrowed, f"{keys}, query {query}, low double, high double, need long, inside long"), "bins")
        few = F.col("inside") <= LISTED
        last = F.nanvl((F.col("low") + F.col("high")) / 2, F.col("low"))  # no double lies between the two
        single = (last <= F.col("low")) | (last >= F.col("high"))
        lists = _per_tile(state.where(few), blocks, scorer, shards, listed, "scores array<double>")
        sorted_ = F.sort_array(F.flatten(F.collect_list("scores")), asc=False)
        lists = lists.groupBy(*STEP).agg(sorted_.alias("_s"))
        found.append(state.where(few).select(*STEP, "need").join(lists, STEP).select(
            *STEP, F.element_at("_s", F.least(F.col("need"), F.size("_s")).cast("int")).alias("nth")))
        found.append(state.where(~few & single).select(*STEP, F.col("low").alias("nth")))
        open_ = state.where(~few & ~single)
        if open_.isEmpty():
            break
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def cross_entropy_dense(steps: DataFrame, items: DataFrame, scorer: Scorer, shards: int | None = None,
                        block: int = BLOCK) -> DataFrame:
    """(n, loss): mean softmax cross-entropy of the target over all items.

    steps: STEP, query, target; items: ``idx, domain, item, bias``.
    """
    known, blocks = with_own_score(steps, items, scorer), in_blocks(items, scorer, block)
    ranged = score_range(known, blocks, scorer, shards)
    loss = F.log("mass") + F.col("top") - F.col("own_score")
    return ranged.agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"))


def bpr_max_dense(steps: DataFrame, items: DataFrame, scorer: Scorer, n: int | None = None, lmbda: float = 1.0,
                  shards: int | None = None, block: int = BLOCK) -> DataFrame:
    """(n, loss): mean BPR-max over the n highest scores of each step, a third of the items (one at least) by default.

    The target may be among them. Of scores that tie at place n, as many count
    as fit.
    """
    known, blocks = stored(with_own_score(steps, items, scorer), "known"), in_blocks(items, scorer, block)
    take = F.floor(F.col("n") / 3) if n is None else F.lit(n)
    ranged = stored(score_range(known, blocks, scorer, shards).withColumn(
        "need", F.greatest(F.lit(1), F.least(take, F.col("n"))).cast("long")), "ranged")
    cut = stored(ranged.join(nth_best(ranged, blocks, scorer, shards), STEP), "cut")

    def terms(own, top, scores):
        weight = np.exp(scores - top)
        return weight, weight / (1 + np.exp(scores - own)), weight * scores * scores

    def summed(rows: pd.DataFrame, scores: np.ndarray) -> tuple:
        nth, own, top = (rows[c].to_numpy()[:, None] for c in ("nth", "own_score", "top"))
        above = scores > nth
        return (above.sum(axis=1), *((above * t).sum(axis=1) for t in terms(own, top, scores)))

    columns = ("weight", "active", "squares")
    sums = _per_tile(cut, blocks, scorer, shards, summed, "above long, " + ", ".join(f"{c} double" for c in columns))
    sums = sums.groupBy(*STEP).agg(*[F.sum(c).alias(c) for c in ("above", *columns)])
    s, own = F.col("nth"), F.col("own_score")
    tied, weight = F.col("need") - F.col("above"), F.exp(s - F.col("top"))
    norm = F.col("weight") + tied * weight
    active = F.col("active") + tied * weight / (1 + F.exp(s - own))
    squares = F.col("squares") + tied * weight * s * s
    per_step = cut.join(sums, STEP).select((-F.log(active / norm) + lmbda * squares / norm).alias("loss"))
    return per_step.agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"))
