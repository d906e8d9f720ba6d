"""Runs of one domain inside a session, and their context vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickpath.functions.columns import (
    DAY_SLOTS, DWELL_SLOTS, HOUR_SLOTS, KIND_SLOTS, half_even, hour_of_day, mean_log2, one_hot,
)
from clickpath.schema import DOMAIN, RUN, SESSION


def with_runs(sessions: DataFrame) -> DataFrame:
    """Adds ``run_no``: consecutive rows of one domain share it."""
    by_pos = Window.partitionBy(*SESSION).orderBy("pos")
    changed = F.coalesce((F.lag(DOMAIN).over(by_pos) != F.col(DOMAIN)).cast("int"), F.lit(0))
    return sessions.withColumn("_new", changed).withColumn(
        "run_no", F.sum("_new").over(by_pos)).drop("_new")


def collapse_runs(sessions: DataFrame, merchants: DataFrame, day_from: str = "own") -> DataFrame:
    """One row per run: domain, joined keywords, dwell bucket, hour and day of
    its last event, merchant flag.

    The dwell bucket is the rounded mean log2 dwell, null when that is minus
    infinity. ``day_from='boundary'`` takes the day of the event that ends the
    run, i.e. the first of the next run.
    """
    rows = with_runs(sessions)
    if day_from == "boundary":
        by_pos = Window.partitionBy(*SESSION).orderBy("pos")
        changes = F.lead(DOMAIN).over(by_pos) != F.col(DOMAIN)
        rows = rows.withColumn("day", F.when(changes, F.lead("day").over(by_pos)).otherwise(F.col("day")))
    keywords = F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "keywords"))), lambda e: e["keywords"]))
    runs = rows.groupBy(*RUN).agg(
        F.first(DOMAIN).alias(DOMAIN),
        keywords.alias("keywords"),
        half_even(mean_log2(F.col("dwell"))).alias("dwell_bucket"),
        F.max_by(hour_of_day(F.col("sec")), "pos").alias("hour"),
        F.max_by("day", "pos").alias("day"),
    )
    return flag_merchants(runs, merchants)


def flag_merchants(df: DataFrame, merchants: DataFrame) -> DataFrame:
    flags = merchants.select(DOMAIN, F.lit(1).alias("_flag"))
    return (df.join(flags, DOMAIN, "left")
            .withColumn("is_merchant", F.coalesce("_flag", F.lit(0))).drop("_flag"))


def as_steps(runs: DataFrame) -> DataFrame:
    """Runs as session steps: ``pos`` is the run number."""
    return runs.withColumn("pos", F.col("run_no"))


def slots_vector() -> Column:
    """dwell, hour, day and kind one-hots, one after the other."""
    return F.concat(
        one_hot(F.col("dwell_bucket"), DWELL_SLOTS),
        one_hot(F.col("hour"), HOUR_SLOTS),
        one_hot(F.col("day"), DAY_SLOTS),
        one_hot(F.col("is_merchant"), KIND_SLOTS),
    )


def with_context_vector(runs: DataFrame, keyword_mean: str = "kw_vec", name: str = "context") -> DataFrame:
    """Keyword mean followed by the one-hot slots."""
    return runs.withColumn(name, F.concat(F.col(keyword_mean), slots_vector()))
