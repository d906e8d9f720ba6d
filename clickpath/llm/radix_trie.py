"""The prefix trie of conversations, by adaptive radix trees over sorted ranges.

A turn is a fixed-width big-endian id, a conversation the bytes of its turns'
ids. Conversations are range-sorted by these bytes; every range builds a radix
tree of its own and sends a row per node, that is per byte depth at which a
turn ends. What a range adds up under a node, all ranges that share the node
add up to: only the nodes on the first and the last path of a range can be
shared, and what two neighbours count twice follows from their touching paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickpath.llm.common import WORD
from clickpath.runtime import stored

#: Of a turn's id, 12 bytes are a hash of role and text, 4 the number of words of the text.
HASH_BYTES, WIDTH = 12, 16
KEY_BYTES = 8 << 20  # of the conversations that one tree takes


class Branch:
    """A node of the radix tree: a run of bytes without a choice, then up to 256 ways on.

    The run is ``key[begin:end]`` of any conversation below (path compression).
    Ways on lie in a layout that grows: up to 4 or 16 sorted bytes beside their
    branches, an index of 256 places into 48 branches, or 256 branches.
    """

    __slots__ = ("key", "begin", "end", "members", "layout", "bytes", "ways", "edge")

    def __init__(self, key: bytes, begin: int, end: int):
        self.key, self.begin, self.end = key, begin, end
        self.members: list[int] = []
        self.layout, self.bytes, self.ways = 4, bytearray(), []
        self.edge = False

    def way(self, byte: int) -> Branch | None:
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.ways[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.ways[at - 1] if at else None
        return self.ways[byte]

    def add(self, byte: int, branch: Branch) -> None:
        if self.layout < 256 and len(self.ways) == self.layout:
            self._grow()
        if self.layout <= 16:
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.ways.insert(at, branch)
        elif self.layout == 48:
            self.ways.append(branch)
            self.bytes[byte] = len(self.ways)
        else:
            self.ways[byte] = branch

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for i, byte in enumerate(self.bytes):
                index[byte] = i + 1
            self.layout, self.bytes = 48, index
        else:
            self.ways = [self.ways[i - 1] if i else None for i in self.bytes]
            self.layout, self.bytes = 256, bytearray()

    def branches(self) -> list[Branch]:
        return [w for w in self.ways if w is not None] if self.layout == 256 else self.ways

    def split(self, at: int) -> None:
        """End the run at ``at``; what follows goes to a branch of its own."""
        lower = Branch(self.key, at + 1, self.end)
        lower.members, lower.layout, lower.bytes, lower.ways = self.members, self.layout, self.bytes, self.ways
        self.members, self.layout, self.bytes, self.ways = [], 4, bytearray(), []
        self.end = at
        self.add(self.key[at], lower)


def common(a: bytes, b: bytes, begin: int, end: int) -> int:
    """Up to where a and b agree, from ``begin`` (before which they do) to ``end`` at most."""
    end = min(end, len(a), len(b))
    if a[begin:end] == b[begin:end]:
        return end
    while end - begin > 1:
        half = (begin + end) // 2
        if a[begin:half] == b[begin:half]:
            begin = half
        else:
            end = half
    return begin


def insert(root: Branch, key: bytes, member: int) -> None:
    branch = root
    while True:
        at = common(branch.key, key, branch.begin, branch.end)
        if at < branch.end:
            branch.split(at)
        if at == len(key):
            branch.members.append(member)
            return
        onward = branch.way(key[at])
        if onward is None:
            onward = Branch(key, at + 1, len(key))
            onward.members.append(member)
            branch.add(key[at], onward)
            return
        branch = onward


def _mark(root: Branch, key: bytes) -> None:
    """Flag the branches on the path of a key that the tree holds."""
    branch = root
    while True:
        branch.edge = True
        if branch.end == len(key):
            return
        branch = branch.way(key[branch.end])


def prefix_ids(key: bytes) -> list[bytes]:
    """A name for the prefix of each number of turns, from none to all."""
    running = hashlib.sha256()
    out = [running.digest()[:16]]
    for at in range(0, len(key), WIDTH):
        running.update(key[at:at + WIDTH])
        out.append(running.copy().digest()[:16])
    return out


def words_of(key: bytes, depth: int) -> int:
    """Words in the last text of the prefix of ``depth`` turns; the root has no text."""
    return int.from_bytes(key[depth * WIDTH - 4:depth * WIDTH], "big") if depth else 0


def _ids_text(members: list[int]) -> str:
    return ",".join(map(str, members))


# a node's fields, as lists of NODE
DEPTH, MEMBER, CONVS, CHILDREN, LEAVES, SAVED, NAME, PARENT, ENDS = range(9)


def nodes(keys: list[bytes], members: list[int]) -> list[list]:
    """The nodes of the sorted conversations of a range; NAME is None off the range's edges.

    PARENT is the parent's node; ENDS the text of the members that end there.
    """
    root = Branch(keys[0], 0, len(keys[0]))
    root.members.append(members[0])
    for key, member in zip(keys[1:], members[1:]):
        insert(root, key, member)
    names: dict[bytes, list[bytes]] = {}
    for key in (keys[0], keys[-1]):
        _mark(root, key)
        names[key] = prefix_ids(key)
    out: list[list] = []
    #: per branch: members, least member, leaves, saved tokens and topmost nodes of what is below it
    done: dict[int, tuple[int, int, int, int, list[list]]] = {}
    stack = [(root, -1, False)]
    while stack:
        branch, above, ready = stack.pop()
        if not ready:
            stack.append((branch, above, True))
            stack.extend((b, branch.end, False) for b in branch.branches())
            continue
        n, least, leaves, saved = len(branch.members), branch.members[0] if branch.members else None, 0, 0
        top: list[list] = []
        for b in branch.branches():
            own = done.pop(id(b))
            n, leaves, saved = n + own[0], leaves + own[2], saved + own[3]
            least = own[1] if least is None else min(least, own[1])
            top.extend(own[4])
        # the turns that end in this run, the deepest first; the byte that leads here belongs to it
        for depth in range(branch.end // WIDTH, above // WIDTH, -1):
            leaves = leaves if top else 1
            saved += (n - 1) * words_of(branch.key, depth)
            ends = _ids_text(branch.members) if depth * WIDTH == branch.end else ""
            name = None
            if branch.edge:
                key = keys[0] if keys[0][:depth * WIDTH] == branch.key[:depth * WIDTH] else keys[-1]
                name = names[key][depth]
            node = [depth, least, n, len(top), leaves, saved, name, None, ends]
            for child in top:
                child[PARENT] = node
            top = [node]
            out.append(node)
        done[id(branch)] = (n, least, leaves, saved, top)
    return out


NODE_SCHEMA = ("part long, depth long, conv_id long, parent_conv_id long, node binary, parent_node binary, n_convs long, "
               "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, first binary, "
               "last binary")
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in NODE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_pydict({
        name: pa.array(column, _KINDS[kind]) for (name, kind), column in zip(fields, zip(*rows))})


def _of_ranges(keys: DataFrame, key_bytes: int) -> DataFrame:
    """The nodes of each range of (conv_id, key), and a row with the first and last key of each.

    ``part`` ascends with the keys. A tree holds about ``key_bytes`` of them,
    so a task may make several.
    """
    order = ["key", "conv_id"]
    placed = (keys.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("conv_id", "key", F.spark_partition_id().alias("_at")))

    def tree(part: int, held: list[bytes], members: list[int]) -> Iterator[pa.RecordBatch]:
        found, none = [], (None,) * 12
        for n in nodes(held, members):
            edge, above = n[NAME] is not None, n[PARENT]
            known = above is not None and above[NAME] is None
            found.append((
                part, n[DEPTH], n[MEMBER], above[MEMBER] if known else None, n[NAME],
                above[NAME] if above is not None else None, n[CONVS], n[CHILDREN], n[LEAVES], n[SAVED],
                None if edge else hashlib.sha256(n[ENDS].encode()).hexdigest(), n[ENDS] if edge else None, None, None))
            if len(found) >= 50_000:
                yield _rows(found)
                found = []
        yield _rows([*found, (part, None, *none[:10], held[0], held[-1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        members: list[int] = []
        size, part = 0, None
        for batch in batches:
            for conv_id, key, at in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "_at"))):
                part = at << 32 if part is None else part
                held.append(key)
                members.append(conv_id)
                size += len(key) + 64
                if size >= key_bytes:
                    yield from tree(part, held, members)
                    held, members, size, part = [], [], 0, part + 1
        if held:
            yield from tree(part, held, members)

    return stored(placed.mapInArrow(run, NODE_SCHEMA), "nodes")


def _counted_twice(ranges: DataFrame) -> DataFrame:
    """(node, n_children, n_leaves, saved_tokens) to add for what neighbouring ranges share: a path per pair of ranges."""
    order = Window.orderBy("part")  # one row per range
    pairs = (ranges.where("first IS NOT NULL").select("part", "first", F.lag("last").over(order).alias("before"))
             .where("before IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, before in zip(batch.column("first").to_pylist(), batch.column("before").to_pylist()):
                shared = common(first, before, 0, len(first)) // WIDTH
                leaf = -int(len(before) == shared * WIDTH)  # the earlier range took it for a leaf
                names, saved, rows = prefix_ids(first[:shared * WIDTH]), 0, []
                for depth in range(shared, -1, -1):
                    saved += words_of(first, depth)
                    rows.append((names[depth], -int(depth < shared), leaf, saved))
                yield pa.RecordBatch.from_pydict({
                    name: pa.array(column, _KINDS[kind]) for (name, kind), column in zip(
                        (("node", "binary"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long")),
                        zip(*rows))})

    return pairs.select("first", "before").mapInArrow(
        run, "node binary, n_children long, n_leaves long, saved_tokens long")


def _digests(edges: DataFrame) -> DataFrame:
    """(node, ends_sha256): members that end at a shared node, from the ranges' parts of the list in order.

    A digest is a running one, so a node's parts, one per range, pass through
    one task, which holds one part at a time.
    """
    parts = edges.where("ends != ''").select("node", "part", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, rows = None, None, []
        for batch in batches:
            for node, ends in zip(batch.column("node"), batch.column("ends")):
                node = node.as_py()
                if node == now:
                    running.update(b",")
                else:
                    if now is not None:
                        rows.append((now, running.hexdigest()))
                    now, running = node, hashlib.sha256()
                running.update(ends.as_py().encode())
        if now is not None:
            rows.append((now, running.hexdigest()))
            yield pa.RecordBatch.from_pydict({"node": pa.array([r[0] for r in rows], pa.binary()),
                                              "ends_sha256": pa.array([r[1] for r in rows], pa.string())})

    return (parts.repartition("node").sortWithinPartitions("node", "part")
            .mapInArrow(run, "node binary, ends_sha256 string"))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(keys: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """The nodes of all prefixes of (conv_id, key), as COLUMNS; conv_ids differ, a key is whole turn ids."""
    own = _of_ranges(keys, key_bytes)
    edges = own.where("node IS NOT NULL")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    more = _counted_twice(own).select(
        "node", F.lit(None).cast("binary").alias("parent_node"), F.lit(None).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n_convs"), *sums[1:])
    merged = stored(
        edges.select("node", "parent_node", "depth", "conv_id", *sums).unionByName(more).groupBy("node")
        .agg(F.max("parent_node").alias("parent_node"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
             *[F.sum(c).alias(c) for c in sums]), "shared-nodes")
    parents = merged.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"))
    on_edges = (merged.join(parents, "parent_node", "left").join(_digests(edges), "node", "left")
                .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))))
    inner = own.where("node IS NULL AND depth IS NOT NULL")
    # a range's nodes meet the range's own copies of their parents, so no parent's children meet in one task
    of_range = edges.select("part", F.col("node").alias("parent_node")).join(parents, "parent_node")
    below = inner.where("parent_node IS NOT NULL").drop("parent_conv_id").join(of_range, ["part", "parent_node"])
    return (inner.where("parent_node IS NULL").select(*COLUMNS).unionByName(below.select(*COLUMNS))
            .unionByName(on_edges.select(*COLUMNS)))


def turn_id() -> Column:
    """The fixed-width id of a turn, in hex: role and text with their lengths, hashed, then the words of the text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 2 * (WIDTH - HASH_BYTES), "0")
    return F.concat(F.substring(digest, 1, 2 * HASH_BYTES), words)


def conversation_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, ids): the turns' ids of each conversation in order, null turn first, turns that tie by their ids.

    Rows without a conv_id belong to no conversation. Of a turn 16 bytes in hex
    go through the shuffle, whatever its text; a conversation is one row.
    """
    place = F.struct(F.col("turn").isNotNull().alias("there"), "turn", turn_id().alias("id"))
    return (turns.where("conv_id IS NOT NULL").select("conv_id", place.alias("p"))
            .groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["id"]).alias("ids")))


def rebuilt(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, ids): each conversation with its first h turns replaced by those of conversation c - c % every.

    h = crc32(c in decimal) % heads; turns that the other does not have are left out.
    """
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = convs.where(c % every == 0).select(c.alias("_base"), F.slice("ids", 1, heads - 1).alias("_head"))
    joined = convs.withColumn("_base", c - c % every).join(base, "_base", "left")
    head = F.when(F.col("_head").isNull(), F.array().cast("array<string>")).otherwise(F.slice("_head", F.lit(1), h))
    return joined.select("conv_id", F.concat(head, F.slice("ids", h + 1, F.greatest(F.size("ids"), F.lit(1)))).alias("ids"))


def prefix_trie(turns: DataFrame, rebuild: bool = True, key_bytes: int = KEY_BYTES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per prefix.

    turns: conv_id, turn, role, text; other columns are not read. A prefix is
    the first ``depth`` (role, text) pairs of a conversation, null being empty;
    ``conv_id`` is its smallest member. Rows without a conv_id are left out; an
    empty table gives no rows. ``rebuild`` gives conversations common heads first.
    """
    convs = conversation_keys(turns)
    if rebuild:
        convs = rebuilt(stored(convs, "conversations"))
    keys = convs.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"))
    return trie(stored(keys, "keys"), key_bytes)
