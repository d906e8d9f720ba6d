"""Daily merges, tables in buckets, epochs without a sort."""

import re

from pyspark.sql import functions as F

from clickpath.operators import daily, sessions
from clickpath.plans import queries
from conftest import SF

DAY = 86_400


def test_daily_merges_equal_one_run(spark, events):
    """Sessions across one midnight and across two, gaps of exactly the limit, users that come back after days."""
    rows = [(1, DAY - 100, "pa"), (1, DAY + 50, "mb"), (1, DAY + 4_000, "pc"),
            (2, DAY - 1800, "pa"), (2, DAY, "pb"), (2, 3 * DAY + 5, "pc"),
            (3, DAY - 1801, "pa"), (3, DAY, "pb"), (4, 10, "pa"), (5, 2 * DAY + 10, "pa"), (5, 2 * DAY + 10, "pb")]
    rows += [(6, DAY - 900 + 1_000 * k, "pa") for k in range(100)]
    whole = events(rows)
    want = {(r.event_id, r.session_no, r.n_events) for r in sessions.sessionize(whole, 1800).collect()}
    state, found = daily.nothing_open(whole), []
    for day in range(5):
        today = whole.where((F.col("sec") >= day * DAY) & (F.col("sec") < (day + 1) * DAY))
        closed, state = daily.merge_day(today, state, (day + 1) * DAY, 1800)
        found += closed.collect()
        assert {r.guid for r in state.rows.collect()} == ({1, 2, 6}, {6}, set(), set(), set())[day]
    found += daily.finish(state).collect()
    assert len(found) == len(rows)
    assert {(r.event_id, r.session_no, r.n_events) for r in found} == want
    assert daily.finish(daily.nothing_open(whole)).collect() == []


def test_buckets_join_without_a_shuffle(spark):
    cut, logged = queries.bucketed_sides(spark, SF)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lengths = cut.groupBy("guid", "session_no").count()
        joined = lengths.join(logged.groupBy("guid").agg(F.sum("is_click")), "guid")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        exchanges = re.findall(r"Exchange hashpartitioning\(([^,]*)", plan)
        assert "SortMergeJoin" in plan and not any("guid" in e for e in exchanges)
        assert joined.count() == lengths.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_epochs_are_permutations(spark):
    for n in (0, 1, 2, 3, 10, 97):
        table = spark.range(1, n + 1).withColumnRenamed("id", "session_id")
        first, second = ([r.place for r in sessions.epoch_batches(table, epoch, 4, seed=3).orderBy("session_id").collect()]
                         for epoch in (0, 1))
        assert sorted(first) == sorted(second) == list(range(n))
        assert n < 10 or first != second and first != sorted(first)
    again = sessions.epoch_batches(table.orderBy(F.rand()), 0, 4, seed=3).orderBy("session_id").collect()
    assert [r.place for r in again] == first
    assert {r.batch_no for r in again} == set(range(25))
