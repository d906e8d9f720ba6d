"""Near-duplicate documents by BagMinHash signatures of their word shingles.

A text is the multiset of its runs of five words. Each shingle owns Poisson
processes, one for each step of the discretised weights 0, 1, 2, 4, 8, ...,
whose rates are the steps' lengths; each point has a time, a register and a
place within its step. A register keeps the least time of the points whose
place lies under the shingle's count. Two texts then agree in a register with
the chance of their weighted Jaccard similarity, sum(min) / sum(max).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clickpath.llm.common import chain64, forget, mix64, whole_text, widened, window_hashes
from clickpath.runtime import stored

SHINGLE = 5
#: 25 bands of 5 registers: a pair at 0.8 is missed with a chance of 5e-5, below 0.3 few meet.
BANDS, ROWS = 25, 5
REGISTER = np.dtype("<u2")  # what is kept of a register
#: Equal registers from which a pair is verified: of pairs at 0.8 (100 expected) 1 in 1,900 has fewer, at 0.85 none.
HOPE = 85
BLOCK = 512  # texts of a bucket that are compared as one
_POINT = np.uint64(0xD1B54A32D192ED03)


def shingle_hashes(text: str, known: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """A hash per run of ``size`` words; a text of fewer words is one shingle, one of none has none."""
    words = text.encode().split()
    hashes = np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        h = known.get(word)
        if h is None:
            if len(known) >= 500_000:
                known.clear()
            h = known[word] = xxhash.xxh3_64_intdigest(word)
        hashes[i] = h
    return window_hashes(hashes, min(size, len(words))) if len(words) else hashes


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """The signatures, a row per (shingle hashes, counts) bag; an empty bag's registers are all 0.

    All bags advance together: in each round every live process makes its next
    point, and a process ends when its bag's slowest register is faster.
    """
    n = len(bags)
    times = np.full(n * registers, np.inf)
    marks = np.zeros(n * registers, np.uint64)
    bag = np.repeat(np.arange(n), [len(h) for h, _ in bags])
    if not len(bag):
        return marks.reshape(n, registers)
    shingle = np.concatenate([h for h, _ in bags])
    count = np.concatenate([c for _, c in bags]).astype(np.int64)
    # step 0 is (0, 1], step j is (2^(j-1), 2^j]; a count reaches into steps 0 .. ceil(log2(count))
    steps = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    bag, shingle, count = (np.repeat(x, steps) for x in (bag, shingle, count))
    step = np.arange(len(bag)) - np.repeat(np.cumsum(steps) - steps, steps)
    low = np.where(step > 0, 1 << np.maximum(step - 1, 0), 0)
    width = np.where(step > 0, low, 1)
    seed = chain64(shingle, step.astype(np.uint64))
    part = np.minimum(count - low, width)  # how much of the step lies under the count
    at = np.zeros(len(bag))
    point = np.uint64(0)
    while len(bag):
        point += np.uint64(1)
        with np.errstate(over="ignore"):
            r1 = mix64(seed + point * _POINT)
            r2 = mix64(r1 ^ seed)
        at = at - np.log1p(-(r1 >> np.uint64(11)).astype(float) * 2.0 ** -53) / width
        register = ((r2 & np.uint64(0xFFFFFFFF)).astype(np.int64) * registers) >> 32
        place = ((r2 >> np.uint64(32)).astype(np.int64) * width) >> 32
        cell = bag * registers + register
        good = np.flatnonzero((place < part) & (at < times[cell]))
        if len(good):
            order = good[np.lexsort((r1[good], at[good], cell[good]))]
            first = order[np.r_[True, cell[order][1:] != cell[order][:-1]]]
            times[cell[first]] = at[first]
            marks[cell[first]] = mix64(seed[first] ^ point)
        slowest = times.reshape(n, registers).max(axis=1)
        live = at < slowest[bag]
        if not live.all():
            bag, seed, width, part, at = (x[live] for x in (bag, seed, width, part, at))
    return marks.reshape(n, registers)


def bag_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def signed(docs: DataFrame, at_once: int = 200_000) -> DataFrame:
    """(doc_id, body, sig): a hash of the whole text and 16 bits of each register, a row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            out: list[bytes] = []
            bags: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0

            def finish() -> None:
                nonlocal bags, held
                if bags:
                    out.extend(row.tobytes() for row in signatures(bags).astype(REGISTER))
                bags, held = [], 0

            for text in batch.column("_text"):
                bags.append(bag_of(shingle_hashes(text.as_py(), known)))
                held += len(bags[-1][0])
                if held >= at_once:  # bounds the arrays of one round
                    finish()
            finish()
            yield widened(batch, ["doc_id", "body"], {"sig": pa.array(out, pa.binary())})

    text = whole_text()
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("body"), text.alias("_text")).mapInArrow(
        run, "doc_id long, body binary, sig binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), REGISTER).reshape(len(column), BANDS * ROWS)


def with_agreement(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with ``agree``, how many registers are equal, as far as they are enough to hope."""
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("sig").alias("_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("sig").alias("_b")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_registers(batch.column("_a")) == _registers(batch.column("_b"))).sum(axis=1)
            yield widened(batch, ["a", "b"], {"agree": pa.array(agree, pa.int64())})

    return both.mapInArrow(run, "a long, b long, agree long").where(F.col("agree") >= HOPE)


def bag_overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of the counts of two (sorted hashes, counts) bags, 1 for two empty ones."""
    (a, n), (b, m) = x, y
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.minimum(n, m[at])[b[at] == a].sum())
    return both / (int(n.sum()) + int(m.sum()) - both)


def overlap(a: str, b: str, known: dict[bytes, int]) -> float:
    return bag_overlap(*(bag_of(shingle_hashes(t, known)) for t in (a, b)))


def _verified(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """(a, b, near): whether the texts overlap by ``least``."""
    both = (pairs.select("a", "b").join(bodies.select(F.col("id").alias("a"), F.col("text").alias("_a")), "a")
            .join(bodies.select(F.col("id").alias("b"), F.col("text").alias("_b")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            near = [overlap(a.as_py(), b.as_py(), known) >= least
                    for a, b in zip(batch.column("_a"), batch.column("_b"))]
            yield widened(batch, ["a", "b"], {"near": near})

    return both.select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long, near boolean")


def buckets(texts: DataFrame) -> DataFrame:
    """(bucket, id, n): each text's bands that some other text shares, with the number of texts that do."""
    width = ROWS * REGISTER.itemsize
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + width * i, width)) for i in range(BANDS)])
    every = texts.select("id", F.explode(bands).alias("bucket"))
    sizes = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return every.join(sizes, "bucket").select("bucket", "id", "n")


def to_centres(members: DataFrame) -> DataFrame:
    """(a, b): each bucket's texts against its centre, the text that meets most others over all its buckets.

    The original of many edited copies is nearer to each of them than they are
    to each other, so it shares the most bands.
    """
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    centres = (members.select("bucket", "id").join(met, "id").groupBy("bucket")
               .agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("centre")))
    return (members.join(centres, "bucket").where("id != centre")
            .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("id"))
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("cls", "id")).drop("cls")


def in_groups(members: DataFrame, labels: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """(bucket, first, second, side, id, label): the texts of buckets with several classes, in groups to compare.

    Buckets of a single class have none. The texts of others are laid out in
    blocks of about ``block``: a class with that many has blocks of its own, the
    others share some. Each pair of blocks is one group of rows, but for two
    blocks of the same class, so a large class costs no more than its texts
    times the texts beside it.
    """
    held = _labelled(members.select("bucket", "id"), labels)
    per_class = held.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("own"))
    mixed = (per_class.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("classes"), F.sum(F.when(F.col("own") < block, F.col("own"))).alias("small"))
        .where("classes > 1").drop("classes"))
    large = per_class.where(F.col("own") >= block).select("bucket", "label", "own")
    placed = held.join(mixed, "bucket").join(large, ["bucket", "label"], "left")
    pieces = F.ceil(F.coalesce("own", "small") / block)
    slot = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("label")).otherwise(F.col("id"))), pieces)
    pure = F.when(F.col("own").isNotNull(), F.col("label"))
    placed = stored(placed.select("bucket", "id", "label", pure.alias("pure"),
                                  F.xxhash64(pure, slot).alias("block")), "placed")
    blocks = placed.select("bucket", "block", "pure").distinct()
    other = blocks.select("bucket", F.col("block").alias("second"), F.col("pure").alias("other"))
    pairs = (blocks.withColumnRenamed("block", "first").join(other, "bucket")
             .where("first <= second AND NOT coalesce(pure = other, false)").select("bucket", "first", "second"))
    texts_of = placed.select("bucket", "block", "id", "label")
    left = pairs.withColumn("block", F.col("first")).join(texts_of, ["bucket", "block"])
    right = pairs.where("first != second").withColumn("block", F.col("second")).join(texts_of, ["bucket", "block"])
    return (left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
            .select(*GROUP, "side", "id", "label"))


GROUP = ["bucket", "first", "second"]


def _by_group(rows: DataFrame, found_in: Callable, fields: str) -> DataFrame:
    """``found_in(group)`` of each group's rows, a table in the order of its sides; a task holds one batch and one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if carried is None else pa.concat_tables([carried, part])
            keys = np.stack([part.column(c).to_numpy() for c in GROUP], axis=1)
            starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1].tolist()
            carried = part.slice(starts[-1])  # its group may go on
            for begin, end in zip(starts[:-1], starts[1:]):
                yield from found_in(part.slice(begin, end - begin))
        if carried is not None:
            yield from found_in(carried)

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "side").mapInArrow(run, fields)


def _hopeful(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, agree) of the pairs of two classes whose registers give hope."""
    ids, labels, side = (group.column(c).to_numpy() for c in ("id", "label", "side"))
    registers = _registers(group.column("sig").combine_chunks())
    cut = int(np.searchsorted(side, 1))
    whole = cut == len(ids)  # a block against itself
    left, right = slice(0, cut), slice(0 if whole else cut, len(ids))
    if len(ids) <= 64:
        agree = (registers[left][:, None] == registers[right][None]).sum(axis=2)
    else:
        agree = np.zeros((cut, len(ids) - right.start), np.int16)
        for r in range(registers.shape[1]):
            agree += registers[left, r][:, None] == registers[right, r][None]
    good = (agree >= HOPE) & (labels[left][:, None] != labels[right][None])
    if whole:
        good &= ids[left][:, None] < ids[right][None]
    i, j = np.nonzero(good)
    return i, j + right.start, agree[i, j]


def _ids_with_hope(group: pa.Table) -> Iterator[pa.RecordBatch]:
    i, j, _ = _hopeful(group)
    if len(i):
        yield pa.RecordBatch.from_pydict({"id": group.column("id").to_numpy()[np.unique(np.r_[i, j])]})


def _links_in(group: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """Links that join the group's classes: hopeful pairs, the most alike first, unless links before join them already."""
    i, j, agree = _hopeful(group)
    ids, labels = (group.column(c).to_numpy() for c in ("id", "label"))
    bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bag(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in bags:
            bags[k] = tuple(np.frombuffer(group.column(c)[k].as_py(), np.uint64) for c in ("hashes", "counts"))
        return bags[k]

    above: dict[int, int] = {}

    def root(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    found = []
    for k in np.argsort(-agree, kind="stable").tolist():
        x, y = root(int(labels[i[k]])), root(int(labels[j[k]]))
        if x != y and bag_overlap(bag(int(i[k])), bag(int(j[k]))) >= least:
            above[max(x, y)] = min(x, y)
            found.append((int(ids[i[k]]), int(ids[j[k]])))
    if found:
        yield pa.RecordBatch.from_pydict({"a": pa.array([min(f) for f in found], pa.int64()),
                                          "b": pa.array([max(f) for f in found], pa.int64())})


def between_classes(groups: DataFrame, texts: DataFrame, bags: Callable, least: float) -> DataFrame:
    """(a, b): links that join texts of different classes in a bucket, as many as join all that links can join.

    All pairs of two classes are compared by their registers inside the groups'
    tasks. Texts with a hopeful partner are then compared once more, with their
    shingles beside them, and hopeful pairs verified on the spot; what leaves a
    group is a link for each join of classes. ``bags(ids)`` gives the shingles.
    """
    signed_ = groups.join(texts.select("id", "sig"), "id").select(*groups.columns, "sig")
    hopeful = stored(_by_group(signed_, _ids_with_hope, "id long").distinct(), "hopeful-ids")
    if hopeful.isEmpty():
        return hopeful.select(F.col("id").alias("a"), F.col("id").alias("b"))
    with_bags = signed_.join(bags(hopeful), "id").select(*signed_.columns, "hashes", "counts")
    return stored(_by_group(with_bags, lambda g: _links_in(g, least), "a long, b long").distinct(), "links")


def bagged(bodies: DataFrame) -> DataFrame:
    """(id, hashes, counts): the shingles of each text, sorted by hash, as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            bags = [bag_of(shingle_hashes(t.as_py(), known)) for t in batch.column("text")]
            yield widened(batch, ["id"], {"hashes": pa.array([h.tobytes() for h, _ in bags], pa.binary()),
                                          "counts": pa.array([n.astype(np.uint64).tobytes() for _, n in bags], pa.binary())})

    return bodies.mapInArrow(run, "id long, hashes binary, counts binary")


class _Links:
    """The verified pairs so far and the classes that they make."""

    def __init__(self, least: float):
        self.least, self.checked, self.labels = least, [], None

    def near(self) -> DataFrame:
        whole = self.checked[0]
        for part in self.checked[1:]:
            whole = whole.unionByName(part)
        return whole

    def settle(self, pairs: DataFrame, bodies: DataFrame) -> None:
        """Verify until no hopeful pair is left between two classes: first each text's best pair, then the others."""
        for best_only in (True, False):
            if self.checked:
                pairs = stored(_between(pairs.join(self.near().select("a", "b"), ["a", "b"], "left_anti"), self.labels),
                               "hopeful")
            if pairs.isEmpty():
                return
            chosen = pairs
            if best_only:
                ends = pairs.select("agree", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
                    pairs.select("agree", F.col("b").alias("id"), F.col("a").alias("other")))
                best = ends.groupBy("id").agg(F.max(F.struct("agree", (-F.col("other")).alias("o"))).alias("best"))
                other = -F.col("best.o")
                chosen = best.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b")).distinct()
            self.checked.append(stored(_verified(chosen, bodies, self.least), "verified"))
            self.labels = components(self.near().where("near").select("a", "b"))


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of two classes."""
    for end in ("a", "b"):
        own = labels.select(F.col("id").alias(end), F.col("cls").alias(f"_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    return pairs.where("_a != _b").drop("_a", "_b")


def classes(texts: DataFrame, docs: DataFrame, least: float = 0.8) -> DataFrame | None:
    """(id, cls) of the texts that a verified link joins with another, or None; texts: (id, body, sig).

    Two texts that share a band are compared by their registers, unless links
    join them already; pairs that agree in HOPE registers are verified by their
    shingles. Each bucket is first compared with its centre, which joins most
    classes, then all pairs that are left between classes.
    """
    members = stored(buckets(texts), "members")
    links = _Links(least)
    hopeful = stored(with_agreement(to_centres(members), texts), "hopeful")

    def bodies_of(wanted: DataFrame) -> DataFrame:
        named = texts.select("id", "body").join(wanted, "id", "left_semi")
        text = whole_text()
        return stored(docs.select(F.col("doc_id").alias("id"), F.unhex(F.md5(text)).alias("body"), text.alias("text"))
                      .join(named, ["id", "body"], "left_semi").dropDuplicates(["id"]).select("id", "text"), "bodies")

    bodies = bodies_of(hopeful.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links.settle(hopeful, bodies)
    forget(bodies, hopeful)
    more = between_classes(in_groups(members, links.labels), texts, lambda ids: bagged(bodies_of(ids)), least)
    forget(members)
    if more.isEmpty():
        return links.labels
    near = links.near().where("near").select("a", "b") if links.checked else more.limit(0)
    return components(near.unionByName(more))


def components(edges: DataFrame) -> DataFrame:
    """(id, cls): the least id that each linked id is connected with.

    Every id takes the least label next to it, then the label of its label;
    paths shorten by half in each round. Rounds are stored, and the edges that
    already agree no longer count.
    """
    edges = stored(edges.union(edges.select("b", "a")).toDF("id", "other"), "both_ways")
    labels = stored(edges.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("cls")), "labels")
    while True:
        offers = (edges.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id")
                  .agg(F.min("cls").alias("offer")))
        lower = (labels.join(offers, "id")
                 .select("id", F.least("cls", "offer").alias("cls"), F.col("cls").alias("was")))
        roots = labels.select(F.col("id").alias("cls"), F.col("cls").alias("root"))
        jumped = stored(lower.join(roots, "cls", "left").select(
            "id", F.least("cls", F.coalesce("root", "cls")).alias("cls"), "was"), "labels")
        labels = jumped.select("id", "cls")
        if jumped.where("cls != was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, n_rows): a row per doc_id, with the number of rows that have it.

    ``class_id`` is the least doc_id of the texts connected by links of
    ``least`` or more overlap. Equal texts are one text from the start (null and
    empty are equal), whatever their number. Rows without a doc_id, which
    nothing could refer to, are left out; of rows that repeat a doc_id, the
    least text by hash speaks for it.
    """
    docs = docs.where("doc_id IS NOT NULL")
    slim = stored(signed(docs), "signatures")
    own = stored(slim.groupBy("doc_id").agg(F.min(F.struct("body", "sig")).alias("t"), F.count(F.lit(1)).alias("n_rows"))
                 .select("doc_id", "n_rows", "t.*"), "own")
    texts = stored(own.groupBy("body").agg(F.min("doc_id").alias("id"), F.any_value("sig").alias("sig")), "texts")
    forget(slim)
    found = classes(texts, docs, least)
    of_text = _labelled(texts.select("body", "id"), found).select("body", F.col("label").alias("class_id"))
    return own.select("doc_id", "body", "n_rows").join(of_text, "body").select("doc_id", "class_id", "n_rows")
