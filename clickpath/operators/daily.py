"""Gap sessions from daily files: one day at a time, with a carried table of open sessions.

A session that ends less than the gap before midnight may go on the next day,
so its rows are carried; all others are finished and written once. A user's
sessions are numbered on from those finished before. A day's work is its own
rows and the carried ones, whatever the history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from clickpath.runtime import stored
from clickpath.schema import ORDER, SESSION, TIME, USER


@dataclass(frozen=True)
class OpenSessions:
    """``rows``: the events of sessions that may go on; ``counts``: (guid, finished), sessions finished per user."""

    rows: DataFrame
    counts: DataFrame


def nothing_open(events: DataFrame) -> OpenSessions:
    """The state before the first day."""
    users = events.select(USER, F.lit(0).cast("long").alias("finished"))
    return OpenSessions(events.where("false"), users.where("false"))


def merge_day(day: DataFrame, before: OpenSessions, until: int, gap: int = 1800) -> tuple[DataFrame, OpenSessions]:
    """Sessions that are finished when the day ends at second ``until``, and what stays open.

    day: the events from the end of the day before to ``until``. The finished
    rows have ``session_no`` and ``n_events`` as ``sessionize`` gives them over
    all days at once. A user with neither new nor carried rows is not touched.
    """
    columns = day.columns
    rows = before.rows.select(*columns).unionByName(day)
    numbered = rows.join(before.counts, USER, "left")
    by_user = Window.partitionBy(USER).orderBy(*ORDER)
    breaks = F.when(F.col(TIME) - F.lag(TIME).over(by_user) > gap, 1).otherwise(0)
    numbered = (
        numbered.withColumn("_break", breaks)
        .withColumn("session_no", F.coalesce("finished", F.lit(0)) + F.sum("_break").over(by_user))
        .withColumn("n_events", F.count(F.lit(1)).over(Window.partitionBy(*SESSION)))
        .withColumn("_last", F.max(TIME).over(Window.partitionBy(*SESSION)))
        .withColumn("_open", F.lit(until) - F.col("_last") <= gap)
    )
    held = stored(numbered.select(*columns, "session_no", "n_events", "_open"), "day")
    # only the last session of a user can be open
    touched = held.groupBy(USER).agg(
        F.max(F.when(F.col("_open"), F.col("session_no")).otherwise(F.col("session_no") + 1)).alias("finished"))
    others = before.counts.join(touched.select(USER), USER, "left_anti")
    counts = stored(touched.unionByName(others), "session-counts")
    finished = held.where(~F.col("_open")).select(*columns, "session_no", "n_events")
    return finished, OpenSessions(held.where("_open").select(*columns), counts)


def finish(state: OpenSessions, gap: int = 1800) -> DataFrame:
    """The sessions that are still open, when no further day comes."""
    last = state.rows.agg(F.max(TIME)).first()[0]
    return merge_day(state.rows.where("false"), state, (last or 0) + gap + 1, gap)[0]
