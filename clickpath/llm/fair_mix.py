"""Mixing sources to target weights by weighted fair queueing, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickpath.llm.common import WORD
from clickpath.runtime import stored

BITS = 60


def place_in_shuffle(seed: int, *parts: Column) -> Column:
    """A repeatable number in [0, 2^60): where a row lies in the shuffle."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(_source, source_size, target): one row per source.

    ``share`` times all sizes is dealt by weight; a source gets at most
    ``most`` times its own size and the rest takes the excess by weight. With
    the sources sorted by limit per weight, those that reach their limit come
    first: the level of the others is what is left over the weights left.
    The windows run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("_no"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    limits = most * F.col("source_size")
    level = F.col("_budget") - F.coalesce(F.sum(limits).over(before), F.lit(0))
    left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    return (
        sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
        .withColumn("_no", F.row_number().over(by_name))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)),
                                            ((F.col("_no") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", level / left)
        .withColumn("_capped", limits < F.col("_level") * F.col("_weight"))
        .withColumn("_level", F.min(F.when(~F.col("_capped"), F.struct(
            F.col("source_size") / F.col("_weight"), "_no", "_level"))).over(everything)["_level"])
        .select("_source", "source_size", "_no",
                F.when(F.col("_capped"), limits.cast("double"))
                .otherwise(F.col("_level") * F.col("_weight")).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2,
        seed: int = 8, block_rows: int = 100_000) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row per row of docs.

    Reads doc_id, source and text. The size is the number of words (null: 0).
    Every document, in the shuffled order of its source and up to ``most``
    times over, gets the virtual finish time (words of the source up to its
    end) / target; all are range-sorted by it and taken while the words of the
    whole mix stay within the budget. Null sources are one source, the last.
    Repeated rows are rows of their own; an empty table gives no rows.

    No source is one task: it is cut into blocks of the shuffle with about
    ``block_rows`` rows of all sources, and blocks and ranges are joined up by
    their sums. Sizes, order and sums are stored, so a lost executor or a rerun
    changes nothing.
    """
    order = place_in_shuffle(seed, F.col("doc_id"), F.col("source"))
    sizes = stored(docs.select(
        "doc_id", F.col("source").alias("_source"), order.alias("_at"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "sizes")
    blocks = sizes.count() // block_rows + 1
    sizes = (sizes
             .withColumn("_key", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("none")))
             .withColumn("_block", F.expr(f"_at div {(1 << BITS) // blocks + 1}L")))

    targets = (source_targets(sizes, weights, share, most)
               .withColumn("_key", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("none"))).drop("_source"))
    in_source = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    block_sums = (sizes.groupBy("_key", "_block").agg(F.sum("size").alias("_sum"))
                  .withColumn("_before", F.coalesce(F.sum("_sum").over(in_source), F.lit(0)))
                  .join(targets, "_key").drop("_sum"))
    in_block = (Window.partitionBy("_key", "_block").orderBy("_at", "doc_id", "size")
                .rowsBetween(Window.unboundedPreceding, 0))
    queued = stored(
        sizes.join(block_sums, ["_key", "_block"])
        .withColumn("_through", F.col("_before") + F.sum("size").over(in_block))
        .drop("_source", "_block", "_before"), "queued")

    turns = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    entries = (queued.where("size > 0").select("_key", "_no", "size", "target", "source_size", "_through", turns.alias("_turn"))
               .select("_key", "_no", "size", finish(F.col("_turn")).alias("_finish")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * most)
    ranged = stored(entries.repartitionByRange(parts, "_finish", "_no", "size")
                    .withColumn("_part", F.spark_partition_id()), "ranged")
    over_parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    part_sums = (ranged.groupBy("_part").agg(F.sum("size").alias("_sum"))
                 .withColumn("_before", F.coalesce(F.sum("_sum").over(over_parts), F.lit(0))).drop("_sum"))
    in_part = (Window.partitionBy("_part").orderBy("_finish", "_no", "size")
               .rowsBetween(Window.unboundedPreceding, 0))
    budget = targets.agg(F.sum("source_size").alias("_all")).select((F.col("_all") * F.lit(float(share))).alias("_budget"))
    budget = (budget.collect()[0][0] or 0.0)
    cuts = (ranged.join(part_sums, "_part")
            .withColumn("_total", F.col("_before") + F.sum("size").over(in_part))
            .where(F.col("_total") <= budget)
            .groupBy("_key").agg(F.max("_finish").alias("_cut")))
    times = sum((F.when(finish(F.lit(t)) <= F.col("_cut"), 1).otherwise(0) for t in range(most)), F.lit(0))
    return (queued.join(cuts, "_key", "left")
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * F.when(F.col("size") > 0, times).otherwise(0)).alias("taken")))


def finish(turn: Column) -> Column:
    """Virtual finish time of a document's turn-th copy."""
    words = turn * F.col("source_size") + F.col("_through")
    return words.cast("double") / F.nullif(F.col("target"), F.lit(0.0))
