import random

from pyspark.sql import functions as F

from clickpath.operators import sessions
from clickpath.operators.skew import in_blocks


def plain_sessions(rows, gap):
    """The rule by a loop over one user's events in order: dwell, session."""
    by_user = {}
    for row in rows:
        by_user.setdefault(row.guid, []).append(row)
    out = {}
    for user_rows in by_user.values():
        user_rows.sort(key=lambda r: (r.sec, r.is_click, r.event_id))
        secs = [r.sec for r in user_rows]
        steps = [b - a for a, b in zip(secs, secs[1:])]
        mean = sum(steps) / len(steps) if steps else None
        no = 0
        for i, r in enumerate(user_rows):
            out[r.event_id] = (float(steps[i]) if i < len(steps) else mean, no)
            if i < len(steps) and steps[i] > gap:
                no += 1
    return out


def check_against_plain(df, gap, heavy_rows):
    rows = df.collect()
    expected = plain_sessions(rows, gap)
    lengths = {}
    by_id = {r.event_id: r for r in rows}
    for event_id, (_, no) in expected.items():
        key = (by_id[event_id].guid, no)
        lengths[key] = lengths.get(key, 0) + 1
    found = sessions.sessionize(df, gap, heavy_rows).collect()
    assert len(found) == len(rows)
    for r in found:
        dwell, no = expected[r.event_id]
        assert r.session_no == no
        assert r.n_events == lengths[(r.guid, no)]
        assert (r.dwell is None) == (dwell is None)
        assert dwell is None or abs(r.dwell - dwell) < 1e-9
    dwells = {r.event_id: r.dwell for r in sessions.with_dwell(df, heavy_rows).collect()}
    assert all(dwells[i] == d or abs(dwells[i] - d) < 1e-9 for i, (d, _) in expected.items())


def skewed_rows(n=1500, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        guid = 0 if rng.random() < 0.4 else rng.randrange(1, 60)
        # bursts, long silences and repeated seconds
        sec = rng.randrange(0, 40) * 10_000 + rng.choice([0, 5, 600, 1800, 1801, 3600, rng.randrange(4000)])
        rows.append((guid, sec, rng.choice(["m1", "m2", "p1", "p2", "p3"])))
    return rows


def test_dwell_and_exact_gap(events):
    df = events([(1, 0, "p1"), (1, 1800, "p2"), (1, 3601, "m1"), (2, 5, "p1")])
    rows = {r.event_id: r for r in sessions.sessionize(df).collect()}
    assert [rows[i].dwell for i in range(3)] == [1800.0, 1801.0, 1800.5]
    # a gap of exactly 1800 seconds keeps the session open, 1801 ends it
    assert [rows[i].session_no for i in range(3)] == [0, 0, 1]
    assert [rows[i].n_events for i in range(3)] == [2, 2, 1]
    assert rows[3].dwell is None and rows[3].session_no == 0


def test_ties_put_impressions_before_clicks(events):
    df = events([(1, 10, "m1"), (1, 10, "p1"), (1, 20, "p2")])
    rows = sessions.with_pos(sessions.sessionize(df)).orderBy("pos").collect()
    assert [r.domain for r in rows] == ["p1", "m1", "p2"]
    assert [r.dwell for r in rows] == [0.0, 10.0, 5.0]


def test_light_users(events):
    check_against_plain(events(skewed_rows()), 1800, heavy_rows=1_000_000)


def test_heavy_user_is_split_and_gives_the_same(events):
    df = events(skewed_rows())
    blocks, heavy = in_blocks(df, "guid", "sec", 50)
    assert heavy and not in_blocks(df, "guid", "sec")[1]
    per_block = blocks.groupBy("guid", "_block").count().collect()
    assert sum(r.guid == 0 for r in per_block) > 5
    assert max(r["count"] for r in per_block) < 200
    assert all(r._block == 0 for r in per_block if r.guid != 0)
    check_against_plain(df, 1800, heavy_rows=50)


def test_heavy_session_over_many_blocks(events):
    rows = [(0, 60 * i, "p1") for i in range(400)] + [(1, 10 * i, "p2") for i in range(5)]
    found = sessions.sessionize(events(rows), 1800, heavy_rows=20)
    assert {(r.guid, r.session_no, r.n_events) for r in found.collect()} == {(0, 0, 400), (1, 0, 5)}


def test_bursts_of_a_heavy_user_are_cut_evenly(events):
    rng = random.Random(9)
    # nearly all rows of user 0 fall into one of many hours
    rows = [(0, 500_000 + rng.randrange(3600), "p1") for _ in range(900)]
    rows += [(0, rng.randrange(1_000_000), "m1") for _ in range(100)] + [(g, g * 10, "p2") for g in range(1, 50)]
    df = events(rows)
    sizes = [r["count"] for r in in_blocks(df, "guid", "sec", 50)[0].groupBy("guid", "_block").count().collect()]
    assert max(sizes) < 60 and sum(sizes) == len(rows)
    check_against_plain(df, 1800, heavy_rows=50)


def test_heavy_user_in_one_second(events):
    check_against_plain(events([(0, 7, "p1")] * 100 + [(1, 1, "p1"), (1, 2, "m1")]), 1800, heavy_rows=20)


def test_matches_session_window(events):
    df = events(skewed_rows(seed=5))
    ours = sessions.session_summary(sessions.sessionize(df)).select("guid", "start_sec", "n_events")
    stamped = df.withColumn("t", F.timestamp_seconds("sec"))
    theirs = stamped.groupBy("guid", F.session_window("t", "1800 seconds")).agg(
        F.min("sec").alias("start_sec"), F.count(F.lit(1)).alias("n_events")).select("guid", "start_sec", "n_events")
    assert sorted(ours.collect()) == sorted(theirs.collect())


def test_one_shuffle_serves_all_windows(events):
    plan = sessions.sessionize(events(skewed_rows(50)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Window ") >= 4


def test_bounds_and_distinct(events):
    rows = ([(1, i, "p1") for i in range(2)] + [(2, i, f"p{i % 2}") for i in range(3)]
            + [(3, i, "p1") for i in range(20)] + [(4, i, f"p{i}") for i in range(21)])
    df = events(rows)
    bounded = sessions.bounded_sessions(df)
    assert {r.guid for r in bounded.collect()} == {2, 3}
    assert {r.guid for r in sessions.multi_domain(bounded).collect()} == {2}
    assert {r.guid for r in sessions.filter_min_distinct(sessions.sessionize(df)).collect()} == {2, 4}
    kept = sessions.filter_session_length(df, ["guid"], heavy_rows=5)
    assert sorted({r.guid for r in kept.collect()}) == [2, 3] and kept.count() == 23


def test_drop_repeats_keeps_revisits(visits):
    flat = sessions.drop_repeats(visits({0: "a a b b a", 1: "c"})).orderBy("session_no", "pos")
    assert [(r.pos, r.domain) for r in flat.collect()] == [(0, "a"), (1, "b"), (2, "a"), (0, "c")]


def test_pairs_seen_prev_last(visits):
    df = visits({0: "a b a c"})
    assert [(r.pos, r.domain, r.target) for r in sessions.next_item_pairs(df).orderBy("pos").collect()] == [
        (0, "a", "b"), (1, "b", "a"), (2, "a", "c")]
    assert [r.seen_before for r in sessions.with_seen_before(df).orderBy("pos").collect()] == [0, 0, 1, 0]
    assert [(r.prev, r.domain) for r in sessions.with_prev(df).orderBy("pos").collect()] == [
        ("a", "b"), ("b", "a"), ("a", "c")]
    assert [r.domain for r in sessions.last_step_only(df).collect()] == ["c"]
    assert [r.next_domain for r in sessions.with_next(df, ["domain"]).orderBy("pos").collect()] == [
        "b", "a", "c", None]


def test_shuffles_keep_rows_and_repeat(visits):
    df = visits({i: "a b c d e f" for i in range(5)})
    once, again = (sessions.shuffle_sessions(df, seed=1).orderBy("session_no", "pos").collect() for _ in range(2))
    assert once == again and once != df.orderBy("session_no", "pos").collect()
    assert sorted((r.session_no, r.domain) for r in once) == sorted((r.session_no, r.domain) for r in df.collect())
    assert sorted({r.pos for r in once}) == list(range(6))
    assert sessions.sample_sessions(df, 3, seed=1).count() == 3
    assert sessions.shuffle_rows(df, ["session_no", "pos"], 1).count() == 30
