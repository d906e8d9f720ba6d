"""Sessions under a factor model: folded in by normal equations; rounds of alternating least squares.

The items' factors Y are known. The vector x of a session that visited item i
n_i times minimises  sum c_i (p_i - x.y_i)^2 + reg |x|^2  over all items, with
p_i = 1 and c_i = 1 + alpha n_i for visited items, else 0 and 1. Its normal
equations are the Gram matrix of all items, the same for every session, plus
what the few visited items add. ``alternated`` solves them by a system as large
as the session has items, not as the factors are many (Woodbury's identity).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickpath.runtime import drop_table, stored
from clickpath.schema import DOMAIN, SESSION, STEP

AT_ONCE = 64  # systems that are solved together
SHARD_SESSIONS, VISITS_AT_ONCE = 1 << 16, 1 << 15  # sessions of a task, visits whose vectors are held together


def gram(items: DataFrame, dim: int) -> np.ndarray:
    """Y'Y of the factors (``vec``). A task sends one sum; dim x dim numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            rows = _matrix(batch.column("vec"), dim)
            total += rows.T @ rows
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.ravel()], pa.list_(pa.float64()))})

    factors = items.select(F.col("vec").cast("array<double>").alias("vec"))
    cells = (factors.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("cell", "value"))
             .groupBy("cell").agg(F.sum("value").alias("value")))
    out = np.zeros(dim * dim)
    for cell, value in cells.collect():
        out[cell] = value
    return out.reshape(dim, dim)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(-1, dim)


def fold_in(sessions: DataFrame, items: DataFrame, dim: int, alpha: float = 1.0, reg: float = 0.1,
            name: str = "query") -> DataFrame:
    """sessions with ``name``: the session's vector from the visits up to and with each row.

    sessions: STEP, domain; items: domain, vec (``dim`` factors). Visits of
    domains without factors add nothing; before the first known visit the
    vector is zero. A session's rows are sorted and pass through one task,
    which holds its running equations and AT_ONCE of them to solve.
    """
    shared = gram(items, dim) + reg * np.eye(dim)
    factors = items.select(DOMAIN, F.col("vec").cast("array<double>").alias("_y"))
    visits = sessions.join(factors, DOMAIN, "left")
    ordered = visits.select(*sessions.columns, "_y").repartition(*SESSION).sortWithinPartitions(*STEP)
    fields = ", ".join(f"`{c}` {sessions.schema[c].dataType.simpleString()}" for c in sessions.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left, right, met = None, None, None, set()
        for rows in batches:
            solved, lefts, rights = [], [], []

            def solve() -> None:
                if lefts:
                    solved.extend(np.linalg.solve(np.stack(lefts), np.stack(rights)[:, :, None])[:, :, 0])
                    lefts.clear()
                    rights.clear()

            for session, domain, y in zip(zip(*(rows[c] for c in SESSION)), rows[DOMAIN], rows["_y"]):
                if session != now:
                    now, left, right, met = session, shared.copy(), np.zeros(dim), set()
                if y is not None:
                    y = np.asarray(y)
                    left = left + alpha * np.outer(y, y)
                    right = right + (alpha if domain in met else 1 + alpha) * y
                    met.add(domain)
                lefts.append(left)
                rights.append(right)
                if len(lefts) >= AT_ONCE:
                    solve()
            solve()
            yield rows.drop(columns="_y").assign(**{name: solved})

    return ordered.mapInPandas(run, f"{fields}, `{name}` array<double>")


def sharded(visits: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Stored visits with ``_shard``, the items of every shard, and the number of shards.

    visits: session and item (numbered from 0), n above 0, a row per session and item.
    """
    held = stored(visits.withColumn("_shard", F.floor(F.col("session") / SHARD_SESSIONS)), "visits")
    shards = held.agg(F.max("_shard").alias("last")).first().last + 1
    return held, stored(held.select("_shard", "item").distinct(), "wanted"), shards


def alternated(held: DataFrame, wanted: DataFrame, shards: int, items: DataFrame, dim: int, alpha: float = 1.0,
               reg: float = 0.1) -> DataFrame:
    """Stored items (item, vec) after a round: all sessions solved from the items, then all items from the sessions.

    The first three are made by ``sharded``. The weight of a row's squared length
    is ``reg`` times its visits, and vectors are rounded to single precision, as in
    Spark's ALS. A shard's task holds its sessions' vectors and the factors of the
    items it has; per item it sends a sum, or the sessions' vectors if they are few.
    """
    shared = gram(items, dim)
    upper = np.triu_indices(dim)

    def run(visits: pa.Table, factors: pa.Table) -> pa.Table:
        session, item, n = (visits.column(c).to_numpy() for c in ("session", "item", "n"))
        names, known = factors.column("item").to_numpy(), _matrix(factors.column("vec").combine_chunks(), dim)
        by_name = np.argsort(names)
        names, known = names[by_name], known[by_name].astype(float)
        order = np.lexsort((item, session))
        at, more = np.searchsorted(names, item[order]), alpha * n[order].astype(float)
        number = np.cumsum(np.diff(session[order], prepend=session[order[0]]) != 0)
        solved = _sessions(known, at, more, number, shared, reg)
        out = [(-1, 0, 0, _squares(solved, np.ones(len(solved)))[upper], np.zeros(dim))]
        rows = np.argsort(at, kind="stable")
        for mine in np.split(rows, np.flatnonzero(np.diff(at[rows])) + 1):
            vectors, weights = solved[number[mine]], more[mine]
            right = (1 + weights) @ vectors
            if 2 * len(mine) < dim:
                sent, left = len(mine), (np.sqrt(weights)[:, None] * vectors).ravel()
            else:
                sent, left = 0, _squares(vectors, weights)[upper]
            out.append((names[at[mine[0]]], len(mine), sent, left, right))
        found, met, few, lefts, rights = zip(*out)
        return pa.table({
            "item": pa.array(found, pa.int32()), "met": pa.array(met, pa.int64()), "few": pa.array(few, pa.int32()),
            "lhs": pa.array([x.astype(float).tobytes() for x in lefts], pa.binary()),
            "rhs": pa.array([x.astype(float).tobytes() for x in rights], pa.binary())})

    def added(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.zeros((dim, dim)), np.zeros(dim)
        for few, lhs, rhs in zip(*(rows.column(c) for c in ("few", "lhs", "rhs"))):
            part = np.frombuffer(lhs.as_py())
            if few.as_py():
                part = part.reshape(-1, dim)
                left[upper] += (part.T @ part)[upper]
            else:
                left[upper] += part
            right += np.frombuffer(rhs.as_py())
        return left + np.triu(left, 1).T, right

    def whole(rows: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([added(rows)[0].tobytes()], pa.binary())})

    sides = held.repartition(shards, "_shard"), wanted.join(items, "item").repartition(shards, "_shard")
    parts = stored(sides[0].groupBy("_shard").cogroup(sides[1].groupBy("_shard")).applyInArrow(
        run, "item int, met bigint, few int, lhs binary, rhs binary"), "item-sums")
    total = parts.where("item < 0").groupBy("item").applyInArrow(whole, "sums binary").collect()
    base = np.frombuffer(total[0].sums).reshape(dim, dim)

    def solve(rows: pa.Table) -> pa.Table:
        left, right = added(rows)
        met = sum(rows.column("met").to_pylist())
        vector = np.linalg.solve(base + left + reg * met * np.eye(dim), right).astype(np.float32)
        return pa.table({"item": rows.column("item")[:1], "vec": pa.array([vector], pa.list_(pa.float32()))})

    out = stored(parts.where("item >= 0").groupBy("item").applyInArrow(solve, "item int, vec array<float>"), "factors")
    drop_table(parts)
    return out


def _squares(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weight times v v', in double precision."""
    total = np.zeros((vectors.shape[1], vectors.shape[1]))
    for k in range(0, len(vectors), VISITS_AT_ONCE):
        some = vectors[k:k + VISITS_AT_ONCE].astype(float)
        total += (weights[k:k + VISITS_AT_ONCE, None] * some).T @ some
    return total


def _sessions(known: np.ndarray, at: np.ndarray, more: np.ndarray, number: np.ndarray, shared: np.ndarray,
              reg: float) -> np.ndarray:
    """A vector per session. Visits lie by session, which ``number`` counts from 0.

    With A the shared matrix and U the m visited items, C their weights:
    (A + U'CU) x = U'(1 + c) has x = A^-1 U'w with (I + C U A^-1 U') w = 1 + c.
    """
    dim = known.shape[1]
    first = np.flatnonzero(np.diff(number, prepend=-1))
    lengths = np.diff(first, append=len(number))
    solved = np.empty((len(first), dim), np.float32)
    for m in np.unique(lengths).tolist():
        own = shared + reg * m * np.eye(dim)
        inverse = np.linalg.inv(own) if m < dim else None
        mine = np.flatnonzero(lengths == m)
        step = max(1, VISITS_AT_ONCE // m)
        for some in np.split(mine, range(step, len(mine), step)):
            rows = first[some][:, None] + np.arange(m)
            used, weights = known[at[rows]], more[rows]
            if m >= dim:
                left = own + np.swapaxes(used * weights[:, :, None], 1, 2) @ used
                right = np.swapaxes(used, 1, 2) @ (1 + weights)[:, :, None]
                solved[some] = np.linalg.solve(left, right)[:, :, 0]
                continue
            different, place = np.unique(at[rows], return_inverse=True)
            through = (known[different] @ inverse)[place.reshape(rows.shape)]
            small = np.eye(m) + weights[:, :, None] * (used @ np.swapaxes(through, 1, 2))
            inner = np.linalg.solve(small, (1 + weights)[:, :, None])
            solved[some] = (np.swapaxes(inner, 1, 2) @ through)[:, 0]
    return solved
