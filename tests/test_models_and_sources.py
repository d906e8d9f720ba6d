import random

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from clickpath.functions.columns import dot
from clickpath.operators import factors, models, numbering, scoring, sessions, vectors
from clickpath.operators.histories import nest_histories, order_history
from clickpath.runtime import scratch_path, shared_folder, stored
from clickpath.sources import events as sources


def test_corpus_closes_with_stop_tokens(visits):
    rows = models.word2vec_corpus(visits({0: "a b a"})).collect()
    assert rows[0].tokens == ["a", "b", "a", "UNK", "UNK", "UNK"]


def planted(visits):
    """Two groups of domains that never meet."""
    groups = ["a b c d", "b a d c", "c d a b"], ["w x y z", "x w z y", "y z w x"]
    return visits({i: groups[i % 2][i % 3] for i in range(60)})


def test_skip_gram_vectors(visits):
    corpus = models.word2vec_corpus(planted(visits))
    once, again = ({r.domain: r.vec for r in models.domain_vectors(
        corpus, size=8, iterations=5, partitions=1, seed=3).collect()} for _ in range(2))
    assert once == again and set(once) == set("abcdwxyz") | {"UNK"}
    assert all(len(v) == 8 for v in once.values())


def test_als_factors_tell_planted_groups_apart(spark, visits):
    flat = planted(visits)
    factors = models.item_factors(flat, factors=4, iterations=5, seed=1)
    assert factors.count() == 8
    vocab = numbering.vocabulary(flat, spark.createDataFrame([], "domain string"))
    steps = vectors.session_vector(flat.join(factors, "domain")).select(
        "guid", "session_no", "pos", F.col("session_vec").alias("query"), F.col("domain").alias("own"))
    best = scoring.top_scores(steps, scoring.vector_items(vocab, factors), scoring.dot_scorer, 4)
    mixed = best.join(steps.select("guid", "session_no", "pos", "own"), ["guid", "session_no", "pos"]).where(
        F.col("own").isin(*"abcd") != F.col("candidate").isin(*"abcd"))
    assert mixed.count() == 0


def test_factors_are_those_of_spark_s_als(spark, visits, monkeypatch):
    draw, solve, sizes = random.Random(2), np.linalg.solve, []
    flat = visits({n: " ".join(f"d{draw.randrange(4 + n % 9)}" for _ in range(3 + n % 15)) for n in range(300)})
    flat = flat.union(visits({n: " ".join(f"r{draw.randrange(40)}" for _ in range(20)) for n in range(300, 310)}, guid=2))
    ids = flat.groupBy("guid", "session_no", "domain").agg(F.count(F.lit(1)).cast("float").alias("n")).join(
        numbering.index_column(flat, "domain", "item"), "domain").join(
        numbering.number_sessions(flat, first=0, name="session"), ["guid", "session_no"]).select(
        F.col("session").cast("int"), F.col("item").cast("int"), "domain", "n").cache()
    monkeypatch.setattr(factors, "SHARD_SESSIONS", 128)
    for rank, iterations in ((12, 3), (5, 2)):
        model = ALS(rank=rank, maxIter=iterations, implicitPrefs=True, seed=4, userCol="session", itemCol="item",
                    ratingCol="n").fit(ids)
        want = {r.domain: r.features for r in model.itemFactors.join(
            ids.select("domain", F.col("item").alias("id")).distinct(), "id").collect()}
        got = {r.domain: r.vec for r in models.item_factors(flat, rank, iterations, seed=4).collect()}
        assert got.keys() == want.keys()
        assert max(np.abs(np.subtract(got[d], want[d])).max() for d in want) < 2e-4 * max(map(max, want.values()))
    monkeypatch.setattr(factors.np.linalg, "solve", lambda a, b: sizes.append(a.shape[-1]) or solve(a, b))
    known, at, number = np.random.default_rng(1).normal(size=(9, 30)), np.array([0, 3, 8, 1, 3]), np.array([0, 0, 0, 1, 1])
    factors._sessions(known, at, np.ones(5), number, known.T @ known, 0.1)
    assert sorted(sizes) == [2, 3]  # systems as large as sessions have domains, not as there are factors


def test_negative_samples_follow_the_rows(visits):
    flat = visits({i: "a b" if i < 90 else "c d" for i in range(100)})
    drawn = models.negative_samples(flat, seed=1)
    assert drawn.count() == 200 and sorted(drawn.collect()) == sorted(models.negative_samples(flat, seed=1).collect())
    shares = {r.negative: r["count"] for r in drawn.groupBy("negative").count().collect()}
    assert shares["a"] + shares["b"] > 150
    head = {r.negative for r in models.negative_samples(flat, seed=1, pool="head").collect()}
    assert head <= {"a", "b"}


def test_training_examples(spark, visits):
    runs = visits({0: "m1 p1 m1"}).withColumn("is_merchant", F.col("domain").startswith("m").cast("int")).withColumn(
        "context", F.array(F.col("pos").cast("double")))
    vecs = spark.createDataFrame([("m1", [1.0, 2.0])], "domain string, vec array<float>")
    vocab = spark.createDataFrame([("m1", 1, 0), ("p1", 0, 1)], "domain string, is_merchant int, idx long")
    prior = F.array(F.lit(7.0), F.lit(7.0))
    rows = models.training_examples(runs, vecs, prior, vocab).orderBy("pos").collect()
    assert [(r.input_vec, r.target, r.target_idx, r.target_is_merchant, r.seen_before, r.next_context) for r in rows] == [
        ([1.0, 2.0, 0.0], "p1", 1, 0, 0, [1.0]), ([7.0, 7.0, 1.0], "m1", 0, 1, 1, [2.0])]


def raw_logs(spark, time, domain, words):
    return spark.createDataFrame(
        [(1, 100 + d, f"{domain[0]}{d}", ["w"], 2017, 6, d) for d in range(1, 11)],
        f"guid long, {time} long, {domain} string, {words} array<string>, year int, month int, day int")


def test_daily_partitions_are_pruned(spark):
    path = scratch_path(spark, "logs")
    raw_logs(spark, "timestamp", "domainId", "pu_keywords").write.partitionBy("year", "month", "day").parquet(path)
    week = sources.read_events(spark, path, "2017-06-02", "2017-06-08")
    assert sorted(r.day for r in week.collect()) == list(range(2, 9))
    scan = [line for line in week._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line][0]
    assert "PartitionFilters: [" in scan and "day#" in scan.split("PartitionFilters: [")[1].split("]")[0]
    shown = sources.project_impressions(week)
    assert shown.columns == ["guid", "sec", "event_id", "is_click", "domain", "keywords", "year", "month", "day"]
    assert {r.is_click for r in shown.collect()} == {0}
    clicked = sources.project_clicks(raw_logs(spark, "timestamp", "merchantDomain", "merc_url_kw"))
    assert clicked.where("is_click = 1").count() == 10


def test_sessions_and_tables_round_trip(spark, events):
    bounded = sessions.bounded_sessions(events([(1, i, f"p{i}") for i in range(4)] + [(2, 5, "p1")]))
    path = scratch_path(spark, "sessions")
    sources.write_sessions(bounded, path)
    back = sources.read_sessions(spark, path)
    pick = ["guid", "session_no", "pos", "sec", "event_id", "domain", "keywords", "dwell"]
    assert sorted(back.select(pick).collect()) == sorted(bounded.select(pick).collect())
    with pytest.raises(Exception):
        sources.write_sessions(bounded, path)
    nested = nest_histories(order_history(events([(1, 1, "p1")])))
    where = scratch_path(spark, "histories")
    sources.write_histories(nested, where)
    assert sources.read_table(spark, where).count() == 1


def test_padding_key(spark):
    path = scratch_path(spark, "vectors")
    sources.write_table(spark.createDataFrame([("a", [1.0, 2.0])], "domain string, vec array<float>"), path)
    found = {r.domain: r.vec for r in sources.read_domain_vectors(spark, path, 2).collect()}
    assert found == {"a": [1.0, 2.0], "0": [0.0, 0.0]}


def test_stored_tables_lie_in_the_shared_folder(spark):
    table = stored(spark.range(5), "numbers")
    assert table.count() == 5
    assert shared_folder(spark) in table.inputFiles()[0].replace("file:", "").replace("///", "/")


def test_dot(spark):
    row = spark.range(1).select(dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))).first()
    assert row[0] == 11.0
