"""The test tables reshaped into event logs, purchases and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickpath.operators import recommend, sessions
from clickpath.runtime import stored
from clickpath.schema import EVENT

# Fixed values of the test tables
GAP = 21_600
LONG_GAP = 86_400
TEST_FROM = 1_706_054_400  # 2024-01-24 00:00 UTC
DIM = 64
RARE = 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def actions(spark: SparkSession, sf_dir: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Every event as an impression (is_click 0) or a click (1).

    ``sec`` comes from the calendar fields: the same in every session time zone.
    ``days``, the first and the last as ISO dates, is tested on the table's own
    time stamp, where the scan can take it over.
    """
    rows = table(spark, sf_dir, "events")
    if days:
        rows = rows.where(f"ts >= timestamp_ntz'{days[0]}' AND ts < timestamp_ntz'{days[1]}' + interval 1 day")
    return (
        rows.selectExpr(
            "*",
            "cast(get_json_object(props, '$.k') AS int) AS k",
            "cast(event_type IN ('click', 'purchase') AS int) AS is_click")
        .selectExpr(
            "user_id AS guid",
            "unix_date(cast(ts AS date)) * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS sec",
            "event_id", "is_click",
            "if(is_click = 1, concat('m', k % 20), concat('p', k % 50)) AS domain",
            """if(event_id % 13 = 0, cast(array() AS array<string>),
               array(cast(k AS string), cast(if(k % 10 = 0, 100000 + k, 7 * k + 3) AS string))) AS keywords""",
            "year(ts) AS year", "month(ts) AS month", "day(ts) AS day")
    )


def impressions(acts: DataFrame) -> DataFrame:
    return acts.where("is_click = 0")


def clicks(acts: DataFrame) -> DataFrame:
    return acts.where("is_click = 1")


def daily_cookies(events: DataFrame) -> DataFrame:
    """The same events under an id that changes every day, so that many ids
    lack impressions or clicks."""
    day = F.concat_ws("-", "guid", "year", "month", "day")
    return events.withColumn("guid", day).select(*EVENT)


def merchants(acts: DataFrame) -> DataFrame:
    return clicks(acts).select("domain").distinct()


def keyword_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))


def domain_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of m0..m19, then of p0, p1 and so on; every seventh of each stays unknown."""
    i = F.col("vec_id")
    kind, j = F.when(i < 20, "m").otherwise("p"), F.when(i < 20, i).otherwise(i - 20)
    return (table(spark, sf_dir, "embeddings").where(j % 7 != 0)
            .select(F.concat(kind, j).alias("domain"), F.col("embedding").alias("vec")))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("guid"))
        .join(table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("domain")), "k")
        .select("guid", "domain")
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions of suppliers."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("domain"))


def model_sessions(acts: DataFrame) -> DataFrame:
    """Sessions of 3 to 20 events with at least two different domains."""
    return sessions.multi_domain(sessions.bounded_sessions(acts, GAP))


def flat_sessions(acts: DataFrame) -> DataFrame:
    """Model sessions without consecutive repeats."""
    return sessions.drop_repeats(model_sessions(acts)).select(
        "guid", "session_no", "pos", "sec", "domain", "is_click")


def stored_sessions(acts: DataFrame) -> DataFrame:
    """Flat sessions with their start, written once: recommenders and metrics
    read them several times."""
    return stored(recommend.with_start(flat_sessions(acts)), "flat")


def split(acts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test sessions; test rows have domains known in training."""
    train, test = recommend.split_by_start(stored_sessions(acts), TEST_FROM)
    return train, recommend.restrict_to_known(test, train)
