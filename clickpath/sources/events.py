"""Event logs in, histories and sessions out."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickpath.schema import EVENT, SESSION


def read_events(spark: SparkSession, path: str, from_date: str, to_date: str) -> DataFrame:
    """Daily partitions (year=/month=/day=) between two ISO dates, inclusive.

    The date test is made of plain comparisons of the partition columns, so
    other days are pruned before any file is read.
    """
    return between_dates(spark.read.parquet(path), from_date, to_date)


def between_dates(df: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """Rows between two ISO dates, inclusive, by year, month and day."""
    first, last = date.fromisoformat(from_date), date.fromisoformat(to_date)
    months, at = [], first.replace(day=1)
    while at <= last:
        low = first.day if at == first.replace(day=1) else 1
        high = last.day if at == last.replace(day=1) else 31
        months.append((F.col("year") == at.year) & (F.col("month") == at.month) & F.col("day").between(low, high))
        at = (at + timedelta(days=31)).replace(day=1)
    return df.where(reduce(or_, months, F.lit(False)))


def project_impressions(df: DataFrame, time: str = "timestamp", domain: str = "domainId",
                        keywords: str = "pu_keywords") -> DataFrame:
    """Page impressions as event rows."""
    return _as_events(df, 0, time, domain, keywords)


def project_clicks(df: DataFrame, time: str = "timestamp", domain: str = "merchantDomain",
                   keywords: str = "merc_url_kw") -> DataFrame:
    """Clicks on merchants as event rows."""
    return _as_events(df, 1, time, domain, keywords)


def _as_events(df: DataFrame, is_click: int, time: str, domain: str, keywords: str) -> DataFrame:
    # logs without an event id fall back to a hash of the row's own values
    event_id = F.col("event_id") if "event_id" in df.columns else F.xxhash64("guid", time, domain, keywords)
    return df.select(
        "guid",
        F.col(time).cast("bigint").alias("sec"),
        event_id.alias("event_id"),
        F.lit(is_click).alias("is_click"),
        F.col(domain).alias("domain"),
        F.col(keywords).alias("keywords"),
        "year", "month", "day",
    )


def write_table(df: DataFrame, path: str) -> None:
    """Keyword vectors, domain lists, domain vectors: all are plain tables."""
    df.write.mode("errorifexists").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_domain_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Domain vectors with the zero vector of the padding key '0' added."""
    table = read_table(spark, path)
    padding = spark.range(1).select(
        F.lit("0").alias("domain"),
        F.array_repeat(F.lit(0.0), dim).cast(table.schema["vec"].dataType).alias("vec"))
    return table.where(F.col("domain") != "0").unionByName(padding)


def nest_sessions(sessions: DataFrame) -> DataFrame:
    """One row per session holding its events in order.

    For length-bounded sessions: the list of a row is as long as the session.
    """
    fields = [c for c in EVENT if c != "guid"] + ["dwell"]
    item = F.struct("pos", *fields)
    return sessions.groupBy(*SESSION).agg(F.array_sort(F.collect_list(item)).alias("events"))


def unnest_sessions(nested: DataFrame) -> DataFrame:
    return nested.select(*SESSION, F.inline("events"))


def write_sessions(sessions: DataFrame, path: str) -> None:
    nest_sessions(sessions).write.mode("errorifexists").parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return unnest_sessions(spark.read.parquet(path))


def write_histories(nested: DataFrame, path: str) -> None:
    """Write nested histories (see histories.nest_histories), in parallel."""
    nested.write.mode("errorifexists").parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int = 200, path: str | None = None) -> DataFrame:
    """Write df as the table ``name``, hashed by keys into buckets and sorted by them in each, and return the table.

    Tables with the same keys and number of buckets join, and are grouped by the
    keys, without a shuffle: the one of the write is the last. ``path`` puts
    the files outside the warehouse. A bucket is a file that one task reads, so
    buckets are chosen for the largest table that joins.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)
