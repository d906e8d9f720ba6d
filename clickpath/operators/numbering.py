"""Dense numbers over a whole table without sending it through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickpath.runtime import stored


def dense_index(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """Adds ``name``, the 0-based place of each row in the given order.

    Rows are range-partitioned and numbered inside their partition; the sizes
    of the partitions, one row each, go to the driver and give the offsets. The
    numbered rows are stored, since range bounds come from a sample.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = stored(placed, "numbered").withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, before = [], 0
    for part, n in sorted(tuple(row) for row in sizes):
        offsets.append((part, before))
        before += n
    table = df.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    in_part = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return (placed.join(F.broadcast(table), "_part")
            .withColumn(name, in_part + F.col("_before"))
            .drop("_part", "_id", "_before"))


def number_sessions(sessions: DataFrame, first: int = 1, name: str = "session_id") -> DataFrame:
    """(guid, session_no, session_id): sessions counted in key order."""
    keys = ["guid", "session_no"]
    numbered = dense_index(sessions.select(*keys).distinct(), keys, name)
    return numbered.withColumn(name, F.col(name) + first)


def index_column(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Distinct values of a column with dense 0-based numbers."""
    return dense_index(df.select(column).distinct(), [column], name)


def vocabulary(domains: DataFrame, merchants: DataFrame) -> DataFrame:
    """(domain, is_merchant, idx): merchants first, then publishers, by name."""
    flagged = domains.select("domain").distinct().join(
        merchants.select("domain", F.lit(1).alias("is_merchant")), "domain", "left"
    ).select("domain", F.coalesce("is_merchant", F.lit(0)).alias("is_merchant"))
    return dense_index(flagged, [F.col("is_merchant").desc(), F.col("domain")])
