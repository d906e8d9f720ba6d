"""Dense scores: norm bounds, losses over all domains, sessions folded into factors, prefix sums, heavy domains."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickpath.operators import cofactors, evaluate, factors, losses, models, recommend, scoring, sessions, vectors
from clickpath.operators.numbering import vocabulary

DIM = 6


@pytest.fixture(scope="module")
def sides(spark):
    """Steps and items with vectors of either sign, long and short ones, some of them equal."""
    draw = np.random.default_rng(4)
    items = [(i, f"d{i:03}", (draw.normal(size=DIM) * (5.0 if i < 20 else 0.5)).tolist(), float(i % 3) * 0.1) for i in range(200)]
    items += [(200 + i, f"e{i:03}", items[7][2], items[7][3]) for i in range(5)]
    steps = [(1, i // 5, i % 5, draw.normal(size=DIM).tolist(), f"d{draw.integers(0, 200):03}") for i in range(60)]
    steps += [(2, 0, 0, [0.0] * DIM, "d007"), (2, 0, 1, [1.0] * DIM, "unknown")]
    frames = (spark.createDataFrame(steps, "guid long, session_no long, pos int, query array<double>, target string"),
              spark.createDataFrame(items, "idx long, domain string, item array<double>, bias double"))
    matrix = np.array([i[2] for i in items])
    scores = np.array([s[3] for s in steps]) @ matrix.T + np.array([i[3] for i in items])
    return *frames, steps, items, scores


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_skipped_blocks_change_nothing(sides, block):
    steps, items, rows, named, scores = sides
    found = scoring.top_scores(steps, items, scoring.dot_scorer, 4, shards=2, block=block).collect()
    want = set()
    for k, row in enumerate(rows):
        order = sorted(range(len(named)), key=lambda i: (-round(scores[k, i], 12), named[i][1]))[:4]
        want |= {(*row[:3], named[i][1], p + 1) for p, i in enumerate(order)}
    assert {(r.guid, r.session_no, r.pos, r.candidate, r.place) for r in found} == want
    ranks = scoring.dense_target_rank(steps, items, scoring.dot_scorer, shards=2, block=block).collect()
    place = {i[1]: i[0] for i in named}
    for r in ranks:
        k = next(k for k, row in enumerate(rows) if row[:3] == (r.guid, r.session_no, r.pos))
        own = place.get(rows[k][4])
        want_rank = None if own is None else 1 + sum(
            s > scores[k, own] + 1e-12 or abs(s - scores[k, own]) <= 1e-12 and i < own for i, s in enumerate(scores[k]))
        assert r["rank"] == want_rank


def test_few_blocks_are_met(sides):
    steps, items, *_ = sides
    blocks = scoring.in_blocks(items, scoring.dot_scorer, 10)
    known = scoring.with_own_score(steps, items, scoring.dot_scorer)
    share = scoring.block_share(scoring.with_reach(known, blocks, scoring.dot_scorer, F.col("own_score")), blocks).first()
    assert share.steps == 61 and share.blocks == 21
    best = known.withColumn("own_score", F.lit(4.0))  # what long vectors reach only
    few = scoring.block_share(scoring.with_reach(best, blocks, scoring.dot_scorer, F.col("own_score")), blocks).first()
    assert few.met < share.met <= share.steps * share.blocks and few.met < 0.3 * few.steps * few.blocks


@pytest.mark.parametrize("block", [7, 1000])
def test_dense_losses(sides, block, monkeypatch):
    steps, items, rows, named, scores = sides
    place = {i[1]: i[0] for i in named}
    known = [k for k, row in enumerate(rows) if row[4] in place]
    own = np.array([scores[k, place[rows[k][4]]] for k in known])
    assert (scores < 0).any() and (own < 0).any()
    entropy = np.log(np.exp(scores[known]).sum(axis=1)) - own
    found = losses.cross_entropy_dense(steps, items, scoring.dot_scorer, shards=2, block=block).first()
    assert (found.n, found.loss) == (len(known), pytest.approx(entropy.mean()))
    monkeypatch.setattr(losses, "LISTED", 8)  # several rounds of bins
    for n in (None, 11):
        take = max(1, len(named) // 3) if n is None else min(n, len(named))
        top = -np.sort(-scores[known], axis=1)[:, :take]
        weight = np.exp(top)
        active = (weight / (1 + np.exp(top - own[:, None]))).sum(axis=1)
        want = -np.log(active / weight.sum(axis=1)) + 0.5 * (weight * top ** 2).sum(axis=1) / weight.sum(axis=1)
        found = losses.bpr_max_dense(steps, items, scoring.dot_scorer, n=n, lmbda=0.5, shards=2, block=block).first()
        assert (found.n, found.loss) == (len(known), pytest.approx(want.mean()))


def test_huge_scores_do_not_overflow(spark):
    steps = spark.createDataFrame([(1, 0, 0, [1000.0], "a"), (1, 0, 1, [-1000.0], "a")],
                                  "guid long, session_no long, pos int, query array<double>, target string")
    items = spark.createDataFrame([(0, "a", [1.0], 0.0), (1, "b", [2.0], 0.0)], "idx long, domain string, item array<double>, bias double")
    found = losses.cross_entropy_dense(steps, items, scoring.dot_scorer, block=1).first()
    assert found.loss == pytest.approx(500.0)
    none = losses.cross_entropy_dense(steps.limit(0), items, scoring.dot_scorer).first()
    assert (none.n, none.loss) == (0, None)


def test_fold_in_solves_the_normal_equations(spark, visits):
    draw = np.random.default_rng(9)
    y = {name: draw.normal(size=4) for name in "abcde"}
    items = spark.createDataFrame([(d, v.tolist()) for d, v in y.items()], "domain string, vec array<double>")
    found = factors.fold_in(visits({0: "a b a x c", 1: "x", 2: "e"}), items, 4, alpha=2.0, reg=0.3).collect()
    matrix = np.array(list(y.values()))
    shared = matrix.T @ matrix + 0.3 * np.eye(4)
    for r in found:
        seen = {0: "abaxc", 1: "x", 2: "e"}[r.session_no][:r.pos + 1]
        left, right = shared.copy(), np.zeros(4)
        for d in set(seen) - {"x"}:
            left += 2.0 * seen.count(d) * np.outer(y[d], y[d])
            right += (1 + 2.0 * seen.count(d)) * y[d]
        assert r.query == pytest.approx(np.linalg.solve(left, right).tolist())
    assert len(found) == 7


def test_learned_factors_find_a_planted_pattern(spark, visits):
    """Sessions stay in one of five groups of domains: the target is in the group of what was seen."""
    draw = np.random.default_rng(2)
    plan = {n: " ".join(f"g{n % 5}_{k}" for k in draw.choice(8, 5, replace=False)) for n in range(200)}
    rows = visits(plan)
    train, test = rows.where("session_no < 150"), rows.where("session_no >= 150")
    learned = models.item_factors(train, factors=8, iterations=5)
    vocab = vocabulary(train, train.where("false").select("domain"))
    folded = factors.fold_in(test, learned, 8)
    steps = sessions.next_item_pairs(folded).select("guid", "session_no", "pos", "target", "query")
    ranks = scoring.dense_target_rank(steps, scoring.vector_items(vocab, learned), scoring.dot_scorer)
    by_factors = evaluate.ranking_metrics(ranks, strict=False).first()
    drawn, lots = models.random_sides(steps.drop("query"), vocab, seed=1)
    by_chance = evaluate.ranking_metrics(scoring.dense_target_rank(drawn, lots, scoring.random_scorer), strict=False).first()
    assert by_factors.recall > 0.9 > 2 * by_chance.recall


def test_session_vector_is_a_running_mean(spark):
    draw = np.random.default_rng(6)
    rows, want = [], {}
    for session, length in ((1, 1), (2, 10_000), (3, 7)):
        seen = []
        for pos in range(length):
            vec = None if pos % 10 == 3 or session == 3 and pos < 2 else draw.normal(size=3).tolist()
            seen += [vec] if vec else []
            rows.append((9, session, pos, vec))
            if pos in (0, 1, 2, 3, 6, 9_999):
                want[session, pos] = np.mean(seen, axis=0).tolist() if seen else None
    frame = spark.createDataFrame(rows, "guid long, session_no long, pos int, vec array<double>").repartition(5)
    found = {(r.session_no, r.pos): r.session_vec for r in vectors.session_vector(frame).collect()}
    assert len(found) == len(rows)
    for key, mean in want.items():
        assert found[key] == (None if mean is None else pytest.approx(mean))


def brute_knn(baskets, n_sims):
    counts, size = {}, {}
    for items in baskets.values():
        for d in items:
            size[d] = size.get(d, 0) + 1
            for o in set(items) - {d}:
                counts[d, o] = counts.get((d, o), 0) + 1
    out = set()
    for d in size:
        sims = [(n / math.sqrt((size[d] + 20) * (size[o] + 20)), o) for (x, o), n in counts.items() if x == d]
        out |= {(d, o, round(s, 9)) for s, o in sorted(sims, key=lambda e: (-e[0], e[1]))[:n_sims]}
    return out


def test_heavy_domains_prune_pairs(spark):
    """Few hot domains in most baskets, many rare ones: the lists are the same, most pairs are never made."""
    draw = np.random.default_rng(8)
    baskets = {n: [f"h{k}" for k in draw.choice(12, 8, replace=False)] + [f"r{draw.integers(0, 600)}" for _ in range(3)]
               + ["h0"] * (n % 3) for n in range(400)}
    frame = spark.createDataFrame([(n, d) for n, items in baskets.items() for d in items], "session long, domain string")
    want = brute_knn(baskets, 5)
    for heavy in (1, 40, 256, 5_000):
        found = recommend.item_knn(frame, ["session"], n_sims=5, heavy=heavy)
        assert {(r.domain, r.other, round(r.sim, 9)) for r in found.collect()} == want
    visits = recommend.session_visits(frame, ["session"])
    made = recommend.knn_counts(visits, ["session"], 5, 20, 0.5, 40)[0].count()
    assert made < 0.7 * recommend.cooccurrence(frame, ["session"]).count()


def test_company_vectors_find_planted_groups(spark, visits):
    """Domains of one group share sessions: nearest neighbours are of the same group, the same seed gives the same vectors."""
    draw = np.random.default_rng(3)
    rows = visits({n: " ".join(f"g{n % 4}_{k}" for k in draw.choice(6, 5)) for n in range(120)})
    pairs = cofactors.window_pairs(rows, window=2)
    counts = {}
    for n, items in enumerate([r.split() for r in (
            " ".join(x.domain for x in sorted(own, key=lambda x: x.pos)) for own in
            ([r for r in rows.collect() if r.session_no == n] for n in range(120)))]):
        for i, a in enumerate(items):
            for j, b in enumerate(items):
                if i != j and abs(i - j) <= 2:
                    counts[a, b] = counts.get((a, b), 0) + 1
    assert {(r.domain, r.context): r.n for r in pairs.collect()} == counts
    one, again = (
        {r.domain: np.array(r.vec) for r in cofactors.pair_factors(cofactors.ppmi(pairs), size=8, rounds=3, seed=5).collect()}
        for _ in range(2))
    assert len(one) == 24 and all(np.allclose(one[d], again[d], atol=1e-6) for d in one)
    unit = {d: v / np.linalg.norm(v) for d, v in one.items()}
    for d in unit:
        nearest = max((o for o in unit if o != d), key=lambda o: unit[d] @ unit[o])
        assert nearest.split("_")[0] == d.split("_")[0]
    assert cofactors.pair_factors(cofactors.ppmi(pairs.limit(0)), size=4, rounds=1).collect() == []


def test_word_sums_in_tiles(spark):
    """Few words a block and few keys a shard: the same sums; unknown words, empty lists and equal rows."""
    draw = np.random.default_rng(4)
    known = {f"w{i}": draw.normal(size=3) for i in range(40)}
    rows = [(i, [f"w{k}" for k in draw.integers(0, 50, draw.integers(0, 9))]) for i in range(60)] + [(5, ["w1", "w1"]), (99, None)]
    frame = spark.createDataFrame(rows, "k long, words array<string>")
    table = spark.createDataFrame([(w, v.tolist()) for w, v in known.items()], "word string, vec array<double>")
    want = {}
    for key, words in rows:
        for w in words or []:
            if w in known:
                n, total = want.get(key, (0, np.zeros(3)))
                want[key] = n + 1, total + known[w]
    for block, shard in ((7, 11), (1 << 16, 1 << 16)):
        found = vectors.word_sums(frame, ["k"], "words", table, block, shard).collect()
        assert {r.k: r.n for r in found} == {k: n for k, (n, _) in want.items()}
        assert all(r.sum == pytest.approx(want[r.k][1].tolist()) for r in found)
    assert vectors.word_sums(frame, ["k"], "words", table.limit(0)).collect() == []


def test_shards_get_the_vectors_of_their_words_only(spark):
    """Vectors of words that no row has reach no tile: here they would not even fit in one."""
    table = spark.range(1_000).selectExpr("cast(id AS string) AS word", "array_repeat(cast(id AS double), if(id < 60, 1, 2)) AS vec")
    frame = spark.createDataFrame([(i, [str(i), "0"]) for i in range(60)], "k long, words array<string>")
    found = vectors.word_sums(frame, ["k"], "words", table, 1 << 16, 12).collect()
    assert {r.k: (r.n, r.sum) for r in found} == {i: (2, [float(i)]) for i in range(60)}


def test_rows_without_a_key_do_not_add_to_others(spark):
    frame = spark.createDataFrame([(None, ["a"]), (1, ["a"]), (None, ["a"])], "k long, words array<string>")
    table = spark.createDataFrame([("a", [2.0])], "word string, vec array<double>")
    found = vectors.word_sums(frame, ["k"], "words", table).collect()
    assert {r.k: (r.n, r.sum) for r in found} == {None: (2, [4.0]), 1: (1, [2.0])}
