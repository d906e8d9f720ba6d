"""Keyword counts, vocabularies and domain lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def keyword_counts(events: DataFrame) -> DataFrame:
    """(word, n) over all keyword occurrences."""
    return (events.select(F.explode("keywords").alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def joint_keywords(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """(word, n_impressions, n_clicks): all words of either side."""
    left = keyword_counts(impressions).withColumnRenamed("n", "n_impressions")
    right = keyword_counts(clicks).withColumnRenamed("n", "n_clicks")
    return left.join(right, "word", "full")


def all_keywords(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    return joint_keywords(impressions, clicks).select("word")


def filter_vocab(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """The words that have a vector, with it."""
    return vectors.join(words.select("word").distinct(), "word")


def distinct_domains(events: DataFrame) -> DataFrame:
    """Publishers from impressions, merchants from clicks."""
    return events.select("domain").distinct()


def merchants_in_data(merchants: DataFrame, domains: DataFrame) -> DataFrame:
    return merchants.select("domain").intersect(domains.select("domain"))


def publishers_in_data(merchants: DataFrame, domains: DataFrame) -> DataFrame:
    return domains.select("domain").subtract(merchants.select("domain"))


def common_domains(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("domain").intersect(test.select("domain"))


def domain_keywords(runs: DataFrame) -> DataFrame:
    """Distinct (domain, word); a run without keywords adds the empty word.

    Kept as rows: a popular domain's word set may be long.
    """
    words = F.when(F.size("keywords") == 0, F.array(F.lit(""))).otherwise(F.col("keywords"))
    return runs.select("domain", F.explode(words).alias("word")).distinct()
