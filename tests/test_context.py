import math

import pytest
from pyspark.sql import functions as F

from clickpath.functions.columns import half_even, hour_of_day, one_hot, one_hot_slot
from clickpath.operators import context, sessions, vectors


@pytest.mark.parametrize("value, slot", [
    (0.0, 0), (5.0, 5), (5.9, 5), (19.0, 19), (20.0, 0), (-1.0, 19), (-20.0, 0), (-19.0, 1), (-21.0, 0),
    (-0.5, 0), (float("inf"), 0), (float("-inf"), 0), (float("nan"), 0), (None, 0),
])
def test_one_hot_slot(spark, value, slot):
    df = spark.createDataFrame([(value,)], "v double")
    row = df.select(one_hot_slot(F.col("v"), 20).alias("slot"), one_hot(F.col("v"), 20).alias("vec")).first()
    assert row.slot == slot
    assert row.vec == [1.0 if i == slot else 0.0 for i in range(20)]


def test_rounding_and_hours(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (2.4999,)], "v double")
    assert [r[0] for r in df.select(half_even(F.col("v"))).collect()] == [0, 2, 2, 2]
    df = spark.createDataFrame([(0,), (3599,), (3600,), (86399,), (86400,)], "s long")
    assert [r[0] for r in df.select(hour_of_day(F.col("s"))).collect()] == [0, 0, 1, 23, 0]


def with_day_31(events):
    return events([
        (1, 0, "p1", ["a"], 30), (1, 8, "p1", ["b"], 30), (1, 16, "m1", [], 31), (1, 16, "m1", ["c"], 31),
        (1, 32, "p1", ["d"], 1)])


def test_collapse_runs(spark, events):
    merchants = spark.createDataFrame([("m1",)], "domain string")
    rows = sessions.bounded_sessions(with_day_31(events))
    runs = context.collapse_runs(rows, merchants).orderBy("run_no").collect()
    assert [(r.domain, r.keywords, r.day, r.is_merchant) for r in runs] == [
        ("p1", ["a", "b"], 30, 0), ("m1", ["c"], 31, 1), ("p1", ["d"], 1, 0)]
    # dwells 8, 8 | 0, 16 | mean of the user's dwells 8
    assert [r.dwell_bucket for r in runs] == [3, None, 3]
    edges = context.collapse_runs(rows, merchants, day_from="boundary").orderBy("run_no").collect()
    assert [r.day for r in edges] == [31, 1, 1]


def test_context_vector(spark, events):
    merchants = spark.createDataFrame([("m1",)], "domain string")
    runs = context.collapse_runs(sessions.bounded_sessions(with_day_31(events)), merchants)
    vec = context.with_context_vector(runs.withColumn("kw_vec", F.array(F.lit(0.5)))).orderBy("run_no").collect()[1].context
    assert len(vec) == 1 + 20 + 24 + 31 + 2 and vec[0] == 0.5
    # dwell slot 0, hour 0, day 31 has no place and lands in slot 0, merchant
    assert [i for i, x in enumerate(vec) if x == 1.0] == [1, 21, 45, 77]


def test_mean_vectors_and_lookup(spark):
    vecs = spark.createDataFrame(
        [("m1", [1.0, 2.0]), ("m2", [3.0, 6.0]), ("p1", [9.0, 9.0])], "domain string, vec array<float>")
    merchants = spark.createDataFrame([("m1",), ("m2",), ("m9",)], "domain string")
    prior = vectors.merchant_prior(merchants, vecs)
    assert prior.first().vec == [2.0, 4.0]
    keys = spark.createDataFrame([("p1",), ("x",)], "domain string")
    found = {r.domain: r.vec for r in vectors.lookup_vector(keys, vecs, prior.scalar()).collect()}
    assert found == {"p1": [9.0, 9.0], "x": [2.0, 4.0]}


def test_keyword_means(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<float>")
    runs = spark.createDataFrame(
        [(1, 0, 0, "d", ["a", "a", "b"]), (1, 0, 1, "d", ["zz"]), (1, 0, 2, "e", []), (1, 0, 3, "d", ["b"])],
        "guid long, session_no long, run_no long, domain string, keywords array<string>")
    pairs = spark.createDataFrame(
        [("d", "a"), ("d", "b"), ("d", "zz"), ("e", "")], "domain string, word string")
    means = vectors.domain_keyword_mean(pairs, words, 2)
    assert {r.domain: r.vec for r in means.collect()} == {"d": [0.5, 0.5], "e": [0.0, 0.0]}

    def by_run(fallback):
        found = vectors.run_keyword_mean(runs, words, means, 2, fallback).orderBy("run_no").collect()
        return [[round(x, 6) for x in r.kw_vec] for r in found]

    assert by_run("domain") == [[0.666667, 0.333333], [0.5, 0.5], [0.0, 0.0], [0.0, 1.0]]
    assert by_run("zeros") == [[0.666667, 0.333333], [0.0, 0.0], [0.0, 0.0], [0.0, 1.0]]


def test_session_vector_counts_repeats(visits):
    df = visits({0: "a b a"}).withColumn(
        "vec", F.when(F.col("domain") == "a", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    rows = vectors.session_vector(df).orderBy("pos").collect()
    expected = [[1.0, 0.0], [0.5, 0.5], [2 / 3, 1 / 3]]
    assert all(math.isclose(x, y) for r, e in zip(rows, expected) for x, y in zip(r.session_vec, e))
