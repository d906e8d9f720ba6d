import random

from clickpath.operators import histories, keywords


def test_users_with_both(events):
    df = events([(1, 1, "p1"), (1, 2, "m1"), (2, 1, "p1"), (3, 1, "m1")])
    kept = histories.users_with_both(df.where("is_click = 0"), df.where("is_click = 1"))
    assert sorted((r.guid, r.domain) for r in kept.collect()) == [(1, "m1"), (1, "p1")]


def test_order_history_light_and_heavy(events):
    rng = random.Random(1)
    df = events([(0 if rng.random() < 0.5 else rng.randrange(1, 9), rng.randrange(500), rng.choice(["p1", "m1"]))
                 for _ in range(600)])
    expected = {}
    for guid in range(9):
        mine = sorted((r.sec, r.is_click, r.event_id) for r in df.collect() if r.guid == guid)
        expected |= {event_id: place for place, (_, _, event_id) in enumerate(mine)}
    for heavy_rows in (10**6, 30):
        found = histories.order_history(df, heavy_rows)
        assert {r.event_id: r.pos for r in found.collect()} == expected


def test_nested_history_is_cut_into_parts(events):
    df = histories.order_history(events([(1, i, f"p{i}") for i in range(25)] + [(2, 1, "m1")]))
    parts = histories.nest_histories(df, chunk=10).orderBy("guid", "part").collect()
    assert [(r.guid, r.part, len(r.events)) for r in parts] == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 1)]
    assert [e.domain for r in parts[:3] for e in r.events] == [f"p{i}" for i in range(25)]


def test_rare_domain_drops_the_whole_user(events):
    rows = [(1, i, "p1") for i in range(5)] + [(2, i, "p1") for i in range(5)] + [(2, 9, "p9"), (2, 10, "p9")]
    df = events(rows)
    assert [(r.domain, r.n) for r in histories.frequent_domains(df).collect()] == [("p1", 10)]
    for heavy_rows in (10**6, 4):
        kept = histories.drop_users_with_rare_domains(df, 2, heavy_rows)
        assert {r.guid for r in kept.collect()} == {1} and kept.count() == 5


def test_keyword_tables(spark, events):
    df = events([(1, 1, "p1", ["a", "b", "a"]), (1, 2, "m1", ["b"]), (1, 3, "p2", [])])
    shown, clicked = df.where("is_click = 0"), df.where("is_click = 1")
    assert {(r.word, r.n) for r in keywords.keyword_counts(shown).collect()} == {("a", 2), ("b", 1)}
    assert {(r.word, r.n_impressions, r.n_clicks) for r in keywords.joint_keywords(shown, clicked).collect()} == {
        ("a", 2, None), ("b", 1, 1)}
    vecs = spark.createDataFrame([("a", [1.0]), ("z", [2.0])], "word string, vec array<float>")
    assert [r.word for r in keywords.filter_vocab(keywords.all_keywords(shown, clicked), vecs).collect()] == ["a"]
    assert {(r.domain, r.word) for r in keywords.domain_keywords(df).collect()} == {
        ("p1", "a"), ("p1", "b"), ("m1", "b"), ("p2", "")}


def test_domain_sets(spark):
    merchants = spark.createDataFrame([("m1",), ("m2",)], "domain string")
    domains = spark.createDataFrame([("m1",), ("p1",), ("p1",)], "domain string")
    assert [r.domain for r in keywords.merchants_in_data(merchants, domains).collect()] == ["m1"]
    assert [r.domain for r in keywords.publishers_in_data(merchants, domains).collect()] == ["p1"]
    assert [r.domain for r in keywords.common_domains(merchants, domains).collect()] == ["m1"]
