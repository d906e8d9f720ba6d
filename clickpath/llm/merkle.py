"""A Merkle manifest of a table of documents, with a proof for every row.

Every source has a tree over its rows, one more tree stands over the sources.
A level is worked out by equijoins of its nodes with the computed indices of
their siblings; the rows in slot zero then emit the parents. All that ever
meets in a join is the few nodes of one run, whatever a source holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickpath.llm.common import whole_text
from clickpath.operators.numbering import dense_index
from clickpath.runtime import stored

RUN = 3  # nodes under a parent
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(value: Column) -> Column:
    """'-' for null, else the length in UTF-8 and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _hash(*hashed: Column) -> Column:
    """SHA-256, as 32 bytes, of digests written in hex one after the other."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*hashed))), 256))


def leaf_hash(text: Column) -> Column:
    """The digest of a row of documents, with this text."""
    return F.unhex(F.sha2(F.concat(*[_part(text if c == "text" else F.col(c)) for c in FIELDS]), 256))


def leaves(docs: DataFrame, changed: Column) -> DataFrame:
    """(doc_id, tree, idx, n, digest, now), stored: each row's place among the n of its source.

    ``now`` is the leaf of the row with the text ``changed``. A tree is named
    by a number that ascends with its source. Rows are range-sorted by source,
    doc_id and digest and numbered by the sizes that a source has in each
    range, so one source may fill many ranges.
    """
    hashed = stored(docs.select("doc_id", "source", leaf_hash(F.col("text")).alias("digest"),
                                leaf_hash(changed).alias("now")), "hashes")
    order = ["source", "doc_id", "digest"]
    # rows alike in all three are interchangeable; the last key lets them lie in several ranges
    spread = hashed.withColumn("_row", F.monotonically_increasing_id())
    placed = stored(spread.repartitionByRange(*order, "_row").sortWithinPartitions(*order).drop("_row")
                    .withColumn("_id", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    of_source = Window.partitionBy("source")
    pieces = stored(
        placed.groupBy("_part", "source").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        .select("_part", "source", "_first",
                F.sum("_n").over(of_source).alias("n"), F.min("_first").over(of_source).alias("tree"),
                (F.sum("_n").over(of_source.orderBy("_part")) - F.col("_n")).alias("_before")), "pieces")
    same = (placed["_part"] == pieces["_part"]) & placed["source"].eqNullSafe(pieces["source"])
    return stored(placed.join(pieces, same).select(
        "doc_id", "tree", (F.col("_id") - F.col("_first") + F.col("_before")).alias("idx"), "n", "digest", "now"),
        "leaves")


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes (tree, idx, n, digest) with ``before`` and ``after``: the digests of their run left and right of them."""
    slot = F.col("idx") % RUN
    linked = nodes
    for shift in range(1, RUN):
        # the node that this one follows by ``shift`` slots, counted round the run
        to = F.col("idx") - slot + (slot + shift) % RUN
        linked = linked.join(nodes.select("tree", to.alias("idx"), F.col("digest").alias(f"_d{shift}"),
                                          slot.alias(f"_s{shift}")), ["tree", "idx"], "left")

    def side(left: bool) -> Column:
        out = F.lit(b"")
        for s in range(RUN):
            there = F.lit(s) < slot if left else F.lit(s) > slot
            own = F.coalesce(*[F.when(F.col(f"_s{k}") == s, F.col(f"_d{k}")) for k in range(1, RUN)])
            out = F.concat(out, F.coalesce(F.when(there, own), F.lit(b"")))
        return out

    return linked.select(*nodes.columns, side(True).alias("before"), side(False).alias("after"))


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels below the roots, siblings beside each node, and per level (tree, digest) of the roots that lie there."""
    most = nodes.agg(F.max("n")).collect()[0][0] or 0
    linked, roots = [], [nodes.where("n = 1").select("tree", "digest")]
    while most > 1:
        linked.append(stored(_with_siblings(nodes.where("n > 1")), "level"))
        nodes = linked[-1].where(F.col("idx") % RUN == 0).select(
            "tree", F.floor(F.col("idx") / RUN).alias("idx"), F.ceil(F.col("n") / RUN).alias("n"),
            _hash(F.col("digest"), F.col("after")).alias("digest"))
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        most = -(-most // RUN)
    return linked, roots


STEPS = "array<struct<before:binary,after:binary>>"


def _paths(linked: list[DataFrame], above: list[DataFrame]) -> DataFrame:
    """(tree, idx, steps) of the lowest level: the siblings on the way to where ``above`` goes on.

    above: per level (tree, steps, subroot) of the roots that lie there; the subroot goes along.
    """
    at_root = F.lit(0).cast("long").alias("idx")
    paths = above[len(linked)].select("tree", at_root, "steps", "subroot")
    for level in range(len(linked) - 1, -1, -1):
        up = paths.select("tree", F.col("idx").alias("_up"), F.col("steps").alias("_above"), "subroot")
        own = F.array(F.struct("before", "after"))
        below = (linked[level].withColumn("_up", F.floor(F.col("idx") / RUN)).join(up, ["tree", "_up"])
                 .select("tree", "idx", F.concat(own, "_above").alias("steps"), "subroot"))
        paths = below.unionByName(above[level].select("tree", at_root, "steps", "subroot"))
        if level:
            paths = stored(paths, "paths")
    return paths


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, steps: a row per row of docs.

    docs: doc_id, source, lang, n_chars, text; other columns are not read. A
    leaf is the hash of the five; null is told from empty. Rows lie by doc_id
    (null first; rows that repeat a doc_id by leaf) in the tree of their source,
    the sources (null first, by their UTF-8 bytes) in the tree of the whole.
    ``steps`` is the proof: per level the hex digests left and right of the
    node, a run's lone node having none. ``proof_sha256`` hashes all of them.
    ``changed`` is the text that a row holds now (as it was, if not given);
    ``folded_root`` follows from it and the proof, ``verified`` tells whether
    that is the root. An empty table gives no rows.
    """
    own = leaves(docs, F.col("text") if changed is None else changed)
    linked, roots = _levels(own.select("tree", "idx", "n", "digest"))
    tagged = [r.withColumn("_level", F.lit(i)) for i, r in enumerate(roots)]
    subroots = tagged[0]
    for more in tagged[1:]:
        subroots = subroots.unionByName(more)
    subroots = stored(subroots, "subroots")
    count = subroots.agg(F.count(F.lit(1))).scalar()
    ordered = dense_index(subroots.withColumnRenamed("tree", "_tree"), ["_tree"])
    top = stored(ordered.select(F.lit(0).cast("long").alias("tree"), "idx", count.alias("n"), "digest", "_tree",
                                "_level"), "top")
    high, high_roots = _levels(top.select("tree", "idx", "n", "digest"))
    none = F.array().cast(STEPS)
    ends = [r.select("tree", none.alias("steps"), F.lit(None).cast("binary").alias("subroot")) for r in high_roots]
    subtrees = stored(top.select("idx", "_tree", "_level", F.col("digest").alias("subroot"))
                      .join(_paths(high, ends).select("idx", "steps"), "idx")
                      .select(F.col("_tree").alias("tree"), "_level", "subroot", "steps"), "subtrees")
    above = [subtrees.where(F.col("_level") == i) for i in range(len(linked) + 1)]
    proven = own.join(_paths(linked, above), ["tree", "idx"]).withColumn(
        "_root", high_roots[-1].select("digest").scalar())
    folded = F.aggregate("steps", F.col("now"), lambda acc, s: _hash(s["before"], acc, s["after"]))
    texts = F.transform("steps", lambda s: F.struct(F.lower(F.hex(s["before"])).alias("before"),
                                                    F.lower(F.hex(s["after"])).alias("after")))
    proof = F.array_join(F.transform("steps", lambda s: F.lower(F.hex(F.concat(s["before"], s["after"])))), "")
    return proven.select(
        "doc_id", *[F.lower(F.hex(c)).alias(name) for name, c in (
            ("leaf", "digest"), ("subroot", "subroot"), ("root", "_root"))],
        F.sha2(proof, 256).alias("proof_sha256"), F.lower(F.hex(folded)).alias("folded_root"),
        (folded == F.col("_root")).alias("verified"), texts.alias("steps"))


def tampered(docs: DataFrame) -> Column:
    """The text without its line ends where crc32 of the decimal doc_id is even; null stays null."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
