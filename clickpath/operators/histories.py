"""User histories: both sides' events of a user, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clickpath.operators.skew import HEAVY_ROWS, in_blocks, without_heavy
from clickpath.schema import DOMAIN, ORDER, TIME, USER


def users_with_both(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """All events of the users that have impressions and clicks."""
    events = impressions.unionByName(clicks)
    sides = events.groupBy(USER).agg(
        F.min("is_click").alias("low"), F.max("is_click").alias("high"))
    both = sides.where((F.col("low") == 0) & (F.col("high") == 1)).select(USER)
    return events.join(both, USER, "left_semi")


def order_history(events: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Adds ``pos``, the 0-based place of an event in its user's history."""
    blocks, heavy = in_blocks(events, USER, TIME, heavy_rows)
    in_block = f"row_number() OVER (PARTITION BY {USER}, _block ORDER BY {', '.join(ORDER)}) - 1L"
    if not heavy:
        return blocks.selectExpr(*events.columns, f"{in_block} AS pos")
    return (
        blocks.selectExpr(*events.columns, "_block", f"{in_block} AS _place")
        .join(_rows_before(blocks), [USER, "_block"], "left")
        .selectExpr(*events.columns, "_place + coalesce(_before, 0) AS pos")
    )


def _rows_before(blocks: DataFrame) -> DataFrame:
    """Per block of a heavy user, the rows in its earlier blocks."""
    sizes = (blocks.where(F.col("_rows").isNotNull())
             .groupBy(USER, "_block").agg(F.count(F.lit(1)).alias("_size")))
    earlier = (Window.partitionBy(USER).orderBy("_block")
               .rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(USER, "_block", F.sum("_size").over(earlier).alias("_before"))


def nest_histories(ordered: DataFrame, chunk: int = 10_000) -> DataFrame:
    """One row per user holding the events in order.

    A user with more than ``chunk`` events gets several rows, numbered by
    ``part``: a list stays small enough for one row and no event is dropped.
    """
    item = F.struct("pos", *ORDER, "domain", "keywords", "year", "month", "day")
    return (
        ordered.withColumn("part", F.floor(F.col("pos") / chunk).cast("bigint"))
        .groupBy(USER, "part")
        .agg(F.array_sort(F.collect_list(item)).alias("events"))
    )


def domain_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(DOMAIN).agg(F.count(F.lit(1)).alias("n"))


def frequent_domains(events: DataFrame, min_count: int = 2) -> DataFrame:
    """Domains seen more than ``min_count`` times."""
    return domain_counts(events).where(F.col("n") > min_count)


def drop_users_with_rare_domains(events: DataFrame, min_count: int = 2,
                                 heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Drop every user that touched a domain seen at most ``min_count`` times.

    Heavy domains cannot be rare, so their rows are left out of the join by
    domain with a list of bounded size.
    """
    rare = domain_counts(events).where(F.col("n") <= min_count).select(DOMAIN)
    touched = (
        without_heavy(events.select(USER, DOMAIN), [DOMAIN], max(heavy_rows, min_count))
        .join(rare, DOMAIN, "left_semi")
        .select(USER).distinct()
    )
    return events.join(touched, USER, "left_anti")


def users(events: DataFrame) -> DataFrame:
    return events.select(USER).distinct()
