"""A bigram language model in a log-frequency Bloom filter, and the texts' scores.

A bigram's count is quantised to a level, 1 + floor(log_b count), and the
filter holds one item for each level up to it. A reader probes level after
level until one is missing, so a count can only be overestimated, and with a
falling chance. Word counts are exact. Counts travel to shards of the words and
bigrams, and what the shards know of them back to the blocks of documents.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clickpath.llm.common import chain64, mix64, whole_text
from clickpath.runtime import stored

END = b" "  # no word holds a blank
BASE = 2.0  # of the count levels
HASHES, BITS_PER_ITEM = 6, 9  # about 1.4 % of absent items are taken for present
SLOT = np.uint64(0x9E3779B97F4A7C15)
BLOCK_TOKENS = 1 << 18
PAIR_BYTES = 5  # of a bigram's hash that are kept beside its shard
PAIR_MASK = np.uint64((1 << 8 * PAIR_BYTES) - 1)


@dataclass(frozen=True)
class Figures:
    """What the whole training side adds up to."""

    tokens: int
    words: int
    shards: int


# blocks: documents as numbers into a list of their own distinct words

def _block(doc_ids: list, held: list, texts: list[list[int]], words: dict[bytes, int]) -> dict:
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    lengths = np.fromiter(map(len, texts), np.int32, len(texts))
    small = np.uint16 if len(words) <= 1 << 16 else np.int32
    flat = np.fromiter((t for text in texts for t in text), small, int(lengths.sum()))
    return {"block": uuid.uuid4().hex, "doc_ids": doc_ids, "held_out": held, "lengths": lengths.tobytes(),
            "tokens": flat.tobytes(), "words": hashes.tobytes()}


BLOCK_SCHEMA = ("block string, doc_ids array<long>, held_out array<boolean>, lengths binary, tokens binary, "
                "words binary")


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs (doc_id, text) as blocks of whole documents, about ``block_tokens`` tokens each."""
    rows = docs.select("doc_id", whole_text().alias("text"),
                       F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple[list, list, list, dict]:
            return [], [], [], {END: 0}

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary())
            row = _block(ids, held, texts, words)
            return pa.RecordBatch.from_pydict({k: pa.array([v], kind) for (k, v), kind in zip(row.items(), kinds)})

        (ids, held, texts, words), size = fresh(), 0
        for batch in batches:
            for doc_id, text, apart in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held"))):
                # bytes.lower changes A-Z only; bytes.split parts at ASCII white space only
                tokens = [words.setdefault(w, len(words)) for w in text.encode().lower().split()]
                tokens.append(0)
                ids.append(doc_id)
                held.append(apart)
                texts.append(tokens)
                size += len(tokens)
                if size >= block_tokens:
                    yield out()
                    (ids, held, texts, words), size = fresh(), 0
        if ids:
            yield out()

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, history of each token, document of each token, word hashes)."""
    lengths = np.frombuffer(row["lengths"], np.int32)
    small = np.uint16 if len(row["words"]) <= 8 << 16 else np.int32
    tokens = np.frombuffer(row["tokens"], small).astype(np.int64)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    starts = np.cumsum(lengths) - lengths
    before[starts] = 0  # a text begins after an end
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return tokens, before, doc, np.frombuffer(row["words"], np.uint64)


def _shards(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _packed(hashes: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each hash."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _by_shard(hashes: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its entries) of the shards that have any."""
    shard = _shards(hashes, shards)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(int(k), order[ends[k]:ends[k + 1]]) for k in np.flatnonzero(ends[1:] > ends[:-1])]


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def _singly(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other; a row may be large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


WORDS, PAIRS = 0, 1
WIDTHS = {WORDS: 8, PAIRS: PAIR_BYTES}  # bytes of a hash in the shuffle


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(history, word, hash) of a block's different bigrams, and which of them each token ends."""
    tokens, before, _, words = _read(row)
    codes, place = np.unique(before * len(words) + tokens, return_inverse=True)
    history, word = codes // len(words), codes % len(words)
    return history, word, chain64(words[history], words[word]), place


def _entries(blocks_: DataFrame, shards: int) -> DataFrame:
    """(kind, shard, block, hashes, counts): each block's different words and bigrams with their counts in its training texts.

    An entry of held-out texts alone has count 0: it only asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _singly(batches):
            tokens, _, doc, words = _read(row)
            train = ~np.array(row["held_out"], bool)[doc]
            _, _, hashes, place = _pairs(row)
            own = ((WORDS, words, np.bincount(tokens[train], minlength=len(words))),
                   (PAIRS, hashes, np.bincount(place[train], minlength=len(hashes))))
            for kind, hashes, counts in own:
                parts = _by_shard(hashes, shards)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([kind] * len(parts), pa.int32()),
                    "shard": pa.array([k for k, _ in parts], pa.int64()),
                    "block": pa.array([row["block"]] * len(parts), pa.string()),
                    "hashes": pa.array([_packed(hashes[at], WIDTHS[kind]) for _, at in parts], pa.binary()),
                    "counts": pa.array([_narrow(counts[at]) for _, at in parts], pa.binary())})

    return blocks_.mapInArrow(run, "kind int, shard long, block string, hashes binary, counts binary")


ANSWER_SCHEMA = "kind int, shard long, block string, got binary, tokens long, words long"


def _answers(entries: DataFrame) -> DataFrame:
    """Per kind, shard and block what the block's entries there have in all blocks: words their counts, bigrams the
    level that the shard's filter shows. A row without a block sums up a shard of words, or holds a shard's filter.

    A task meets one shard: about a shard's share of the blocks' different entries; shards are as many as the data need.
    """

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        kind = int(key[0])
        sizes = [len(h) // WIDTHS[kind] for h in frame["hashes"]]
        hashes = _unpacked(b"".join(frame["hashes"]), WIDTHS[kind])
        counts = np.concatenate([_wide(c, n) for c, n in zip(frame["counts"], sizes)])
        known, place = np.unique(hashes, return_inverse=True)
        total = np.bincount(place, counts, len(known)).astype(np.int64)
        there = total > 0
        bits = None
        if kind == PAIRS:
            bits = filled(known[there], total[there])
            total = probed(bits, known)
        ends = np.cumsum(sizes)
        got = [_narrow(total[place[e - n:e]]) for e, n in zip(ends, sizes)]
        return pd.DataFrame({
            "kind": kind, "shard": int(key[1]), "block": [*frame["block"], None], "got": [*got, bits],
            "tokens": int(counts.sum()), "words": int(there.sum())})

    return entries.groupBy("kind", "shard").applyInPandas(answer, ANSWER_SCHEMA)


# the filter

def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-12).astype(np.int64)


def expected(levels: np.ndarray) -> np.ndarray:
    """The mean count of a level, if all counts in it are as likely; 0 for level 0."""
    top = BASE ** levels - 1
    return np.where(levels > 0, (BASE ** (levels - 1) + top) / 2, 0.0)


def _slots(hashes: np.ndarray, lev: int, size: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        a = mix64(hashes + np.uint64(lev) * SLOT)
        b = mix64(a ^ SLOT) | np.uint64(1)
        for k in range(HASHES):
            # the upper half of a 64-bit number, scaled to the size
            yield ((((a + np.uint64(k) * b) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def filled(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter's bits for entries with their counts; its size follows the number of items."""
    levels = level(counts)
    size = max(64, int(levels.sum()) * BITS_PER_ITEM)
    bits = np.zeros(size, bool)
    for lev in range(1, int(levels.max(initial=0)) + 1):
        for slot in _slots(hashes[levels >= lev], lev, size):
            bits[slot] = True
    return size.to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def probed(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    """The level of each entry: how many levels in a row are found."""
    size, bits = int.from_bytes(packed[:8], "little"), np.frombuffer(packed, np.uint8, offset=8)
    out = np.zeros(len(hashes), np.int64)
    live, lev = np.arange(len(hashes)), 0
    while len(live):
        lev += 1
        there = np.ones(len(live), bool)
        for slot in _slots(hashes[live], lev, size):
            some = np.flatnonzero(there)
            slot = slot[some]
            there[some] = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
        live = live[there]
        out[live] = lev
    return out


def _merged(asked: np.ndarray, answers: list[dict], kind: int, shards: int) -> np.ndarray:
    """The answers to a block's entries, from those of the shards."""
    out = np.zeros(len(asked), np.int64)
    by_shard = dict(_by_shard(asked, shards))
    for a in answers:
        if a["kind"] == kind:
            at = by_shard[a["shard"]]
            out[at] = _wide(a["got"], len(at))
    return out


SCORE_SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                "score double")


def scores(docs: DataFrame, weight: float = 100.0, shard_tokens: int = 1 << 20,
           block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of docs.

    Tokens are the words of the text, A-Z lowered, and an end. Texts are
    trained on if crc32(doc_id) mod 7 is not 2; a null doc_id is trained on,
    a null text is empty, rows that repeat count each time. With c, N, V of
    the training tokens, base_score adds log10((c+1) / (N+V+1)); ``score``
    adds log10 of (C + weight * base) / (c(history) + weight), where C is the
    bigram's count by the filter. The first token's history is the end. An
    empty table gives no rows; with nothing to train on both scores are 0.

    Texts are tokenised once, into stored blocks of about ``block_tokens`` tokens.
    Counts go to shards of about ``shard_tokens`` tokens, so neither blocks nor
    shards grow with the data. The filter grows with the corpus, so no worker
    holds all of it: a shard of it lies where its bigrams are counted, and a
    block's probes travel there with its counts, in one shuffle.
    """
    held = stored(blocks(docs, block_tokens), "blocks")
    total = held.agg(F.sum(F.octet_length("tokens") / 2)).collect()[0][0] or 0
    shards = int(total // shard_tokens) + 1
    answers = stored(_answers(_entries(held, shards)), "answers")
    tokens, words = answers.where(f"block IS NULL AND kind = {WORDS}").agg(F.sum("tokens"), F.sum("words")).collect()[0]
    figures = Figures(tokens or 0, words or 0, shards)
    of_block = (answers.where("block IS NOT NULL").groupBy("block")
                .agg(F.collect_list(F.struct("kind", "shard", "got")).alias("answers")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _singly(batches):
            yield _scored(row, figures, weight)

    return held.join(of_block, "block").mapInArrow(run, SCORE_SCHEMA)


def _scored(row: dict, figures: Figures, weight: float) -> pa.RecordBatch:
    tokens, _, doc, words = _read(row)
    counts = _merged(words, row["answers"], WORDS, figures.shards)
    base = (counts + 1) / (figures.tokens + figures.words + 1)
    history, word, hashes, place = _pairs(row)
    levels = _merged(hashes, row["answers"], PAIRS, figures.shards)
    # a bigram occurs no more often than either of its words
    pair = np.minimum(expected(levels), np.minimum(counts[history], counts[word]))
    chance = (pair + weight * base[word]) / (counts[history] + weight)
    n = len(row["doc_ids"])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()),
        "n_tokens": np.bincount(doc, minlength=n).astype(np.int64),
        "n_known": np.bincount(doc, counts[tokens] > 0, n).astype(np.int64),
        "train_tokens": np.full(n, figures.tokens, np.int64),
        "base_score": np.bincount(doc, np.log10(base)[tokens], n),
        "score": np.bincount(doc, np.log10(chance)[place], n)})
