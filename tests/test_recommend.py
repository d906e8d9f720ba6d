import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from clickpath.functions.columns import seeded_number, seeded_residue
from clickpath.operators import evaluate, models, numbering, recommend, scoring, sessions
from clickpath.schema import SESSION, STEP


def random_visits(visits, n=30, kinds=9, seed=4):
    rng = random.Random(seed)
    return visits({i: " ".join(rng.choice("abcdefghi"[:kinds]) for _ in range(rng.randrange(2, 7))) for i in range(n)})


def vocab_of(spark, names, merchants=()):
    rows = [(d, int(d in merchants), i) for i, d in enumerate(names)]
    return spark.createDataFrame(rows, "domain string, is_merchant int, idx long")


def test_popularity_breaks_ties_by_name(visits):
    top = recommend.popularity(visits({0: "a b c c"}), 2).collect()
    assert [(r.candidate, r.n) for r in top] == [("c", 2), ("a", 1)]
    assert math.isclose(top[0].score, 2 / 3)


def test_cooccurrence_is_asymmetric(visits):
    found = recommend.cooccurrence(visits({0: "a a b", 1: "a b"}), SESSION).collect()
    assert {(r.domain, r.other): r.n for r in found} == {("a", "b"): 3, ("b", "a"): 2}


def test_item_knn_norm_and_cut(visits):
    sims = recommend.item_knn(visits({0: "a b", 1: "a c", 2: "a b"}), SESSION, n_sims=1).collect()
    best = {r.domain: (r.other, r.sim) for r in sims}
    assert len(sims) == 3 and best["a"][0] == "b"
    assert math.isclose(best["a"][1], 2 / math.sqrt(23 * 22))


def test_session_popular_counts_earlier_visits(visits):
    popular = recommend.popularity(visits({0: "x x x y"}), 1)
    scores = recommend.session_popular_scores(visits({5: "a b a c"}), popular).collect()
    found = {(r.pos, r.candidate): r.score for r in scores}
    assert found == {(1, "a"): 1.0, (1, "x"): 0.75, (2, "a"): 1.0, (2, "b"): 1.0, (2, "x"): 0.75,
                     (3, "a"): 2.0, (3, "b"): 1.0, (3, "x"): 0.75}


def test_top_k_by_kind(spark):
    scores = spark.createDataFrame(
        [(1, 0, 0, c, s) for c, s in [("m1", .9), ("m2", .8), ("m3", .7), ("p1", .1), ("p2", .2)]],
        "guid long, session_no long, pos int, candidate string, score double")
    vocab = vocab_of(spark, ["m1", "m2", "m3", "p1", "p2"], {"m1", "m2", "m3"})
    best = recommend.recommend_by_kind(scores, vocab, 2).collect()
    assert {(r.candidate, r.place) for r in best} == {("m1", 1), ("m2", 2), ("p2", 1), ("p1", 2)}
    assert [r.candidate for r in recommend.recommend(scores, 2).orderBy("place").collect()] == ["m1", "m2"]


def test_dense_index_and_vocabulary(spark):
    df = spark.createDataFrame([(f"d{i:04d}",) for i in range(500)], "domain string")
    numbered = numbering.dense_index(df.repartition(7), ["domain"]).collect()
    assert {(r.domain, r.idx) for r in numbered} == {(f"d{i:04d}", i) for i in range(500)}
    vocab = numbering.vocabulary(
        spark.createDataFrame([("b",), ("a",), ("z",), ("a",)], "domain string"),
        spark.createDataFrame([("z",), ("y",)], "domain string"))
    assert {(r.domain, r.is_merchant, r.idx) for r in vocab.collect()} == {("z", 1, 0), ("a", 0, 1), ("b", 0, 2)}


def test_splits(spark, visits):
    df = visits({i: "a b" for i in range(10)}).withColumn("sec", F.col("session_no") * 100 + F.col("pos"))
    train, test = recommend.split_by_start(recommend.with_start(df), 700)
    assert {r.session_no for r in train.collect()} == set(range(7))
    assert {r.session_no for r in test.collect()} == {7, 8, 9}
    train, test = recommend.split_tail(df, numbering.number_sessions(df), n_test=2, n_gap=3)
    assert {r.session_no for r in train.collect()} == set(range(5))
    assert {r.session_no for r in test.collect()} == {8, 9}
    known = recommend.restrict_to_known(visits({0: "a q"}), visits({1: "a b"}))
    assert [r.domain for r in known.collect()] == ["a"]


def dense(scores, steps, names):
    """Score matrix rows by step, absent = 0."""
    matrix = {(r.session_no, r.pos): np.zeros(len(names)) for r in steps}
    for r in scores:
        if r.candidate in names:
            matrix[(r.session_no, r.pos)][names.index(r.candidate)] = r.score
    return matrix


def made_scores(spark, steps, names, seed=2, negative=True):
    rng = random.Random(seed)
    low = -3 if negative else 0
    rows = [(r.guid, r.session_no, r.pos, c, float(rng.randrange(low, 4)))
            for r in steps for c in [*names, "unknown"] if rng.random() < 0.6]
    return spark.createDataFrame(rows, "guid long, session_no long, pos int, candidate string, score double")


def brute_rank(scores, t):
    return 1 + int((scores > scores[t]).sum()) + int((scores[:t] == scores[t]).sum())


def test_sparse_rank_equals_dense_rank(spark, visits):
    names = list("abcdefgh")
    steps = sessions.with_prev(random_visits(visits)).withColumn("target", F.col("domain"))
    rows = steps.collect()
    scores = made_scores(spark, rows, names)
    matrix = dense(scores.collect(), rows, names)
    found = evaluate.target_rank(steps, scores, vocab_of(spark, names)).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = brute_rank(matrix[(r.session_no, r.pos)], names.index(r.target)) if r.target in names else None
        assert r["rank"] == expected


def test_rank_by_shared_lists(spark, visits):
    flat = random_visits(visits)
    names = sorted({r.domain for r in flat.collect()})
    vocab = vocab_of(spark, names)
    steps = sessions.with_prev(flat).withColumn("target", F.col("domain"))
    sims = recommend.item_knn(flat, SESSION, n_sims=3)
    shared = evaluate.target_rank(steps, recommend.neighbour_lists(sims), vocab, ["prev"])
    single = evaluate.target_rank(steps, recommend.knn_scores(steps, sims), vocab)
    pick = [*STEP, "target", "rank"]
    assert sorted(shared.select(pick).collect()) == sorted(single.select(pick).collect())
    popular = recommend.popularity(flat, 4).select("candidate", "score")
    by_all = evaluate.global_target_rank(steps, popular, vocab)
    scores = {r.candidate: r.score for r in popular.collect()}
    row = np.array([scores.get(n, 0.0) for n in names])
    assert all(r["rank"] == brute_rank(row, names.index(r.target)) for r in by_all.collect())


def test_metrics_modes(spark):
    ranks = spark.createDataFrame(
        [(1, 0, 1, 1), (1, 0, 2, 9), (1, 0, 3, 10), (1, 1, 1, 20), (1, 1, 2, None)],
        "guid long, session_no long, pos int, rank long")
    strict = evaluate.ranking_metrics(ranks).first()
    assert (strict.n, strict.recall, strict.accuracy) == (5, 0.4, 0.2)
    assert math.isclose(strict.mrr, (1 + 1 / 9) / 5)
    loose = evaluate.ranking_metrics(ranks, strict=False, full_mrr=True).first()
    assert loose.recall == 0.6 and math.isclose(loose.mrr, (1 + 1 / 9 + 1 / 10 + 1 / 20) / 5)
    recalls = [evaluate.ranking_metrics(ranks, k=k, strict=False).first().recall for k in (1, 5, 10, 20)]
    assert recalls == sorted(recalls)
    assert strict.accuracy <= strict.mrr <= strict.recall
    places = evaluate.metrics_by_position(ranks, max_len=4).orderBy("position").collect()
    assert [(r.position, r.n, r.recall) for r in places] == [(0, 2, 0.5), (1, 2, 0.5), (2, 1, 1.0), (3, 0, 0.0)]
    means = evaluate.batch_means(ranks, batch=1).first()
    assert means.batches == 2 and math.isclose(means.recall, (1 + 0) / 2)
    assert evaluate.batch_means(ranks, batch=2, whole_only=True).first().batches == 1
    assert evaluate.drop_last_step(ranks).count() == 4


def test_losses_equal_dense_losses(spark, visits):
    names = list("abcdefghi")
    steps = sessions.with_prev(random_visits(visits)).withColumn("target", F.col("domain"))
    rows = steps.collect()
    vocab = vocab_of(spark, names)
    for negative in (True, False):
        scores = made_scores(spark, rows, names, negative=negative).where("candidate != 'unknown'")
        matrix = dense(scores.collect(), rows, names)
        entropy, bpr = [], []
        for r in rows:
            s, t = matrix[(r.session_no, r.pos)], names.index(r.target)
            entropy.append(np.log(np.exp(s).sum()) - s[t])
            top = np.sort(s)[::-1][:4]
            weight = np.exp(top) / np.exp(top).sum()
            bpr.append(-np.log((weight / (1 + np.exp(top - s[t]))).sum()) + 0.5 * (weight * top ** 2).sum())
        assert math.isclose(evaluate.cross_entropy(scores, steps, vocab).first().loss, np.mean(entropy), rel_tol=1e-9)
        assert math.isclose(evaluate.bpr_max(scores, steps, vocab, n=4, lmbda=0.5).first().loss, np.mean(bpr), rel_tol=1e-9)


def test_blocked_scoring_equals_full_product(spark):
    rng = np.random.default_rng(5)
    queries, items = rng.normal(size=(40, 6)), rng.normal(size=(23, 6))
    names = [f"d{i:02d}" for i in range(23)]
    steps = spark.createDataFrame(
        [(1, i, 0, q.tolist(), names[i % 23]) for i, q in enumerate(queries)],
        "guid long, session_no long, pos int, query array<double>, target string")
    table = spark.createDataFrame(
        [(i, names[i], v.tolist(), 0.1 * i) for i, v in enumerate(items)],
        "idx long, domain string, item array<double>, bias double")
    full = queries @ items.T + 0.1 * np.arange(23)
    best = scoring.top_scores(steps, table, scoring.dot_scorer, 5, shards=3, block=4).collect()
    assert len(best) == 200
    for r in best:
        order = np.argsort(-full[r.session_no], kind="stable")
        assert r.candidate == names[order[r.place - 1]]
    ranks = scoring.dense_target_rank(steps, table, scoring.dot_scorer, shards=3, block=4).collect()
    assert len(ranks) == 40
    for r in ranks:
        row = full[r.session_no]
        assert r["rank"] == 1 + (row > row[r.session_no % 23]).sum()


def test_equal_vectors_tie_in_any_tiles(spark):
    rng = np.random.default_rng(8)
    items = np.repeat(rng.normal(size=(20, 64)), 2, axis=0)
    queries = rng.normal(size=(300, 64))
    names = [f"d{i:02d}" for i in range(40)]
    steps = spark.createDataFrame(
        [(1, i, 0, q.tolist(), names[i % 40] if i % 7 else "unknown") for i, q in enumerate(queries)],
        "guid long, session_no long, pos int, query array<double>, target string")
    table = spark.createDataFrame([(i, names[i], v.tolist(), 0.0) for i, v in enumerate(items)],
                                  "idx long, domain string, item array<double>, bias double")
    full = np.repeat(queries @ items[::2].T, 2, axis=1)
    for block, shards in ((3, 5), (64, None)):
        ranks = scoring.dense_target_rank(steps, table, scoring.dot_scorer, shards, block).collect()
        assert len(ranks) == 300
        for r in ranks:
            assert r["rank"] == (brute_rank(full[r.session_no], r.session_no % 40) if r.session_no % 7 else None)
        best = scoring.top_scores(steps, table, scoring.dot_scorer, 3, shards, block).collect()
        assert len(best) == 900
        for r in best:
            assert r.candidate == names[np.argsort(-full[r.session_no], kind="stable")[r.place - 1]]


def test_long_sessions_meet_in_blocks(visits):
    df = random_visits(visits)
    plain, cut = (recommend.cooccurrence(df, SESSION, block=n).collect() for n in (1000, 2))
    assert sorted(plain) == sorted(cut) and plain


def test_metrics_by_kind_of_target(spark):
    ranks = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("q", None, 1)], "target string, rank long, is_click int")
    found = evaluate.metrics_by_kind(ranks, vocab_of(spark, ["a", "b"], ["a"])).collect()
    assert {r.is_merchant: (r.n, r.recall) for r in found} == {1: (1, 1.0), 0: (1, 1.0), None: (1, 0.0)}


def test_late_positions_are_kept(spark):
    ranks = spark.createDataFrame([(1, 0, p, 1) for p in range(1, 31)], "guid long, session_no long, pos int, rank long")
    assert [r.n for r in evaluate.metrics_by_position(ranks).collect()] == [1] * 30


def test_seeded_numbers_pass_32_bits(spark):
    top = spark.range(50).select(F.max(seeded_number(7, F.col("id")))).first()[0]
    assert 2**32 < top < 2**60


def test_random_scores_are_uniform_and_repeatable(spark):
    steps = spark.range(300).select(F.lit(1).cast("long").alias("guid"), F.col("id").alias("session_no"),
                                    F.lit(1).alias("pos"), F.lit("d03").alias("target"))
    vocab = vocab_of(spark, [f"d{i:02d}" for i in range(20)])
    once = models.random_scores(steps, vocab, 3, seed=1)
    assert once.count() == 900 and sorted(once.collect()) == sorted(models.random_scores(steps, vocab, 3, seed=1).collect())
    drawn, items = models.random_sides(steps, vocab, seed=1)
    ranks = [r["rank"] for r in scoring.dense_target_rank(drawn, items, scoring.random_scorer).collect()]
    assert min(ranks) == 1 and max(ranks) == 20 and 8 < sum(ranks) / len(ranks) < 13
    assert 1 <= spark.range(1).select(seeded_residue(1, F.lit("a"))).first()[0] < scoring.PRIME


def test_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    """Tasks grow with the visits and with the pairs that they make, not with the bytes that are shuffled."""
    baskets = {n: [f"d{(n * 7 + k) % 23}" for k in range(6)] for n in range(200)}
    frame = spark.createDataFrame([(n, d) for n, items in baskets.items() for d in items], "session long, domain string")
    monkeypatch.setattr(recommend, "ROWS_AT_ONCE", 100)
    monkeypatch.setattr(recommend, "PAIRS_AT_ONCE", 200)
    want = {}
    for items in baskets.values():
        for a in items:
            for b in set(items) - {a}:
                want[a, b] = want.get((a, b), 0) + 1
    found = recommend.cooccurrence(frame, ["session"])
    assert {(r.domain, r.other): r.n for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RepartitionByExpression \[session#\d+L\], 36", plan)) == 2
    spread = recommend.session_visits(frame, ["session"]).select(F.spark_partition_id(), F.input_file_name()).distinct()
    assert spread.select(F.countDistinct("input_file_name()")).first()[0] == 12
