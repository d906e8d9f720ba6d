"""Benchmark decontamination by greedy string tiling over shared seeds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clickpath.llm.common import ddl, whole_text, window_hashes, widened
from clickpath.runtime import stored

SEED_WORDS = 5
FILTER_BITS = 1 << 23  # 1 MB, broadcast; a fuller filter lets more seeds reach the join, none is lost


def _seeds(text: str, known: dict[bytes, int], size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words in lower case."""
    words = text.lower().encode().split()
    hashes = np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        h = known.get(word)
        if h is None:
            if len(known) >= 500_000:
                known.clear()
            h = known[word] = xxhash.xxh3_64_intdigest(word)
        hashes[i] = h
    return window_hashes(hashes, size)


def _seed_arrays(rows: DataFrame, key: str, size: int, keep: bytes | None = None) -> DataFrame:
    """(key, n_seeds, at, seed): the seeds of each text with their places; with
    ``keep``, only those that the filter may hold, and texts with any."""
    shared = rows.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        bits = np.frombuffer(shared.value, np.uint8) if shared else None
        for batch in batches:
            counts, places, kept = [], [], []
            for text in batch.column("_text").to_pylist():
                seeds = _seeds(text, known, size)
                at = np.arange(len(seeds))
                if bits is not None and len(seeds):
                    slot = (seeds & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    at = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                counts.append(len(seeds))
                places.append(at)
                kept.append(seeds[at].view(np.int64))
            new = {"n_seeds": pa.array(counts, pa.int64()), "at": pa.array(places, pa.list_(pa.int64())),
                   "seed": pa.array(kept, pa.list_(pa.int64()))}
            out = widened(batch, [key], new)
            if bits is not None:
                out = out.filter(pa.array([len(x) > 0 for x in kept], pa.bool_()))
            yield out

    return (rows.select(key, whole_text().alias("_text"))
            .mapInArrow(run, f"{ddl(rows, [key])}, n_seeds long, at array<long>, seed array<long>"))


def _filter(seeds: DataFrame) -> bytes:
    """A bit per benchmark seed, set by slot number; its size is fixed."""
    slots = seeds.select(F.explode("seed").alias("s")).select(
        F.col("s").bitwiseAND(FILTER_BITS - 1).alias("slot")).groupBy("slot").agg(F.lit(1).alias("one"))
    bytes_ = slots.groupBy(F.shiftright("slot", 3).alias("at")).agg(
        F.sum(F.pow(F.lit(2.0), F.col("slot") % 8)).cast("int").alias("value"))  # slots are distinct
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for at, value in bytes_.toLocalIterator():
        bits[at] = value
    return bits.tobytes()


def tiles(doc_at: np.ndarray, doc_seed: np.ndarray, item_seed: np.ndarray, size: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, words) of the greedy tiling.

    Runs of equal seed hashes at following places are matches of whole words.
    The longest match with no word marked yet is marked first, ties by place
    in the item, then in the document; it goes on until none has ``size``
    words. Matches that overlap a mark are cut to what is left and tried again.
    """
    where: dict[int, list[int]] = {}
    for j, seed in enumerate(item_seed.tolist()):
        where.setdefault(seed, []).append(j)
    place = dict(zip(doc_at.tolist(), doc_seed.tolist()))
    ends: dict[tuple[int, int], int] = {}
    heap: list[tuple[int, int, int]] = []
    # runs from the back: each pair of places is touched once
    ahead: dict[int, int] = {}
    last = None
    for i in sorted(place, reverse=True):
        now: dict[int, int] = {}
        for j in where.get(place[i], ()):
            now[j] = (ahead.get(j + 1, 0) if last == i + 1 else 0) + 1
        for j, run in now.items():
            ends[i, j] = run
        ahead, last = now, i
    for (i, j), run in ends.items():
        if ends.get((i - 1, j - 1), 0) != run + 1:  # only where a run begins
            heap.append((-(run + size - 1), j, i))
    heapq.heapify(heap)
    doc_marks: set[int] = set()
    item_marks: set[int] = set()
    out = []
    while heap:
        length, j, i = heapq.heappop(heap)
        length = -length
        free = [k for k in range(length) if i + k not in doc_marks and j + k not in item_marks]
        if len(free) == length:
            out.append((i, j, length))
            doc_marks.update(range(i, i + length))
            item_marks.update(range(j, j + length))
            continue
        begin = 0
        for k in range(1, len(free) + 1):  # what the marks leave, in unbroken pieces
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - begin >= size:
                    heapq.heappush(heap, (-(k - begin), j + free[begin], i + free[begin]))
                begin = k
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, size: int = SEED_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest): one row per leaked item of a document.

    ``coverage`` is the share of the item's words under tiles that the document
    holds, in any order; rows have at least ``least``. Words are split at ASCII
    white space and compared in lower case, by 64-bit hashes. Items of fewer
    than ``size`` words have no seed and match nothing, nor do null or empty
    texts. Rows of one doc_id, or of one item_id, give one row with the best
    coverage; null ids never match.

    Documents meet items only through equal seeds. A fixed-size filter of the
    benchmark's seeds, which never drops one, leaves the few that are worth a
    join; pairs whose shared seeds could not reach ``least`` are then dropped,
    which loses nothing, since tiles are made of shared seeds. What is tiled is
    one document against one item.
    """
    items = stored(_seed_arrays(benchmark.where("item_id IS NOT NULL"), "item_id", size), "items")
    hits = stored(_seed_arrays(docs.where("doc_id IS NOT NULL"), "doc_id", size, _filter(items)), "hits")
    hits = hits.withColumn("doc_row", F.monotonically_increasing_id())  # the stored files keep these fixed
    hits = stored(hits, "hit_rows")
    items = stored(items.where("n_seeds > 0").withColumn("item_row", F.monotonically_increasing_id()), "item_rows")
    item_seeds = items.select("item_row", "n_seeds", F.explode("seed").alias("s"))
    item_seeds = item_seeds.groupBy("item_row", "n_seeds", "s").agg(F.count(F.lit(1)).alias("times"))
    words = F.col("n_seeds") + (size - 1)
    pairs = (
        hits.select("doc_row", F.explode(F.array_distinct("seed")).alias("s"))
        .join(item_seeds, "s").groupBy("doc_row", "item_row", "n_seeds").agg(F.sum("times").alias("shared"))
        .where(F.least(F.col("shared") * size, words) >= words * least)
        .select("doc_row", "item_row"))
    work = (pairs.join(hits.select("doc_row", "doc_id", "at", "seed"), "doc_row")
            .join(items.select("item_row", "item_id", F.col("seed").alias("item_seed")), "item_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, seed, item in zip(*(batch.column(c) for c in ("at", "seed", "item_seed"))):
                arrays = [np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in (at, seed, item)]
                own = np.isin(arrays[1], arrays[2])
                marks = tiles(arrays[0][own], arrays[1][own], arrays[2], size)
                lengths = [t[2] for t in marks]
                found.append((sum(lengths) / (len(arrays[2]) + size - 1), len(lengths), max(lengths, default=0)))
            yield widened(batch, ["doc_id", "item_id"], {
                "coverage": pa.array([f[0] for f in found], pa.float64()),
                "n_tiles": pa.array([f[1] for f in found], pa.int64()),
                "longest": pa.array([f[2] for f in found], pa.int64())})

    schema = f"{ddl(docs, ['doc_id'])}, {ddl(benchmark, ['item_id'])}, coverage double, n_tiles long, longest long"
    return (work.select("doc_id", "item_id", "at", "seed", "item_seed").mapInArrow(run, schema)
            .where(F.col("coverage") >= least).groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("coverage", "n_tiles", "longest")).alias("best"))
            .select("doc_id", "item_id", "best.*"))
