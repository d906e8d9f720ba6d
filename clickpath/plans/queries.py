"""Registered queries: each takes (spark, sf_dir) and gives a DataFrame."""

from __future__ import annotations

import datetime
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickpath.functions.columns import (
    DAY_SLOTS, DWELL_SLOTS, HOUR_SLOTS, KIND_SLOTS, half_even, hour_of_day, one_hot, one_hot_slot,
)
from clickpath.operators import (
    cofactors, context, daily, evaluate, factors, histories, keywords, losses, models, numbering, recommend, scoring,
    sessions, vectors,
)
from clickpath.plans import views
from clickpath.plans.views import GAP, DIM, LONG_GAP, RARE, TEST_FROM
from clickpath.runtime import scratch_path, stored
from clickpath.schema import RUN, SESSION, STEP
from clickpath.sources import events as sources

WEEK = ("2024-01-08", "2024-01-14")

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def joined(words: str) -> Column:
    return F.concat_ws(" ", F.col(words)).alias(words)


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def digest(vec: str) -> tuple[Column, Column]:
    """Plain and place-weighted sum of a vector: two numbers that change with
    any element."""
    total = "aggregate({}, 0D, (acc, x) -> acc + x)"
    return (F.expr(f"round({total.format(vec)}, 6)"),
            F.expr(f"round({total.format(f'transform({vec}, (x, i) -> x * (i + 1))')}, 6)"))


# -- sources and keywords ----------------------------------------------------

def _scan(df: DataFrame) -> DataFrame:
    return df.select("guid", "sec", "event_id", "domain", joined("keywords"), "year", "month", "day")


@query
def scan_impressions(spark, sf_dir):
    logs = views.impressions(views.actions(spark, sf_dir))
    return _scan(sources.project_impressions(logs, "sec", "domain", "keywords"))


@query
def scan_clicks(spark, sf_dir):
    logs = views.clicks(views.actions(spark, sf_dir))
    return _scan(sources.project_clicks(logs, "sec", "domain", "keywords"))


@query
def scan_week(spark, sf_dir):
    """Seven days of both logs."""
    return _scan(sources.between_dates(views.actions(spark, sf_dir, WEEK), *WEEK))


@query
def scan_partitioned_week(spark, sf_dir):
    """The same days, read back from daily partitioned logs of either side."""
    acts, sides = views.actions(spark, sf_dir), []
    for log, names, project in (
            (views.impressions(acts), ("domainId", "pu_keywords"), sources.project_impressions),
            (views.clicks(acts), ("merchantDomain", "merc_url_kw"), sources.project_clicks)):
        path = scratch_path(spark, "daily")
        log.select("guid", "event_id", F.col("sec").alias("timestamp"), F.col("domain").alias(names[0]),
                   F.col("keywords").alias(names[1]), "year", "month", "day"
                   ).write.partitionBy("year", "month", "day").parquet(path)
        sides.append(project(sources.read_events(spark, path, *WEEK)))
    return _scan(sides[0].unionByName(sides[1]))


@query
def keyword_counts(spark, sf_dir):
    return keywords.keyword_counts(views.actions(spark, sf_dir))


@query
def keyword_full_join(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return keywords.joint_keywords(views.impressions(acts), views.clicks(acts))


@query
def keyword_vectors(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    words = keywords.all_keywords(views.impressions(acts), views.clicks(acts))
    known = keywords.filter_vocab(words, views.keyword_vectors(spark, sf_dir))
    return vectors.long_form(known, ["word"]).select("word", "dim", r6(F.col("value").cast("double")).alias("value"))


@query
def publisher_list(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return keywords.distinct_domains(views.impressions(acts))


@query
def merchant_list(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return keywords.distinct_domains(views.clicks(acts))


@query
def merchants_in_data(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return keywords.merchants_in_data(
        views.merchants(acts), views.model_sessions(acts))


@query
def publishers_in_data(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return keywords.publishers_in_data(
        views.merchants(acts), views.model_sessions(acts))


@query
def vocab_index(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return numbering.vocabulary(views.model_sessions(acts), views.merchants(acts))


# -- histories ---------------------------------------------------------------

def _histories(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    both = histories.users_with_both(
        views.daily_cookies(views.impressions(acts)),
        views.daily_cookies(views.clicks(acts)))
    return histories.order_history(both)


@query
def user_histories(spark, sf_dir):
    return _histories(spark, sf_dir).select("guid", "pos", "sec", "is_click", "event_id", "domain")


@query
def user_histories_nested(spark, sf_dir):
    nested = histories.nest_histories(_histories(spark, sf_dir))
    return nested.select(
        "guid", "part", F.size("events").alias("n_events"),
        F.element_at("events", 1)["domain"].alias("first_domain"),
        F.element_at("events", -1)["domain"].alias("last_domain"))


@query
def histories_roundtrip(spark, sf_dir):
    """Whole histories of the users themselves, written in parts of ten events and read back."""
    acts, path = views.actions(spark, sf_dir), scratch_path(spark, "histories")
    ordered = histories.order_history(histories.users_with_both(views.impressions(acts), views.clicks(acts)))
    sources.write_histories(histories.nest_histories(ordered, chunk=10), path)
    return sources.read_table(spark, path).select("guid", "part", F.inline("events")).select(
        "guid", "part", "pos", "sec", "event_id", "domain", joined("keywords"), "day")


@query
def domain_counts(spark, sf_dir):
    return histories.domain_counts(views.purchases(spark, sf_dir))


@query
def frequent_domains(spark, sf_dir):
    return histories.frequent_domains(views.purchases(spark, sf_dir), RARE)


@query
def users_without_rare_domains(spark, sf_dir):
    kept = histories.drop_users_with_rare_domains(views.purchases(spark, sf_dir), RARE)
    return recommend.support(kept, ["guid"])


# -- sessions ----------------------------------------------------------------

@query
def dwell_time(spark, sf_dir):
    return sessions.with_dwell(views.actions(spark, sf_dir)).select(
        "guid", "event_id", "sec", r6("dwell").alias("dwell"))


@query
def sessionize(spark, sf_dir):
    return sessions.sessionize(views.actions(spark, sf_dir), GAP).select(
        "guid", "event_id", "session_no", "n_events")


@query
def sessions_by_day(spark, sf_dir):
    """A week's sessions, merged day by day; some go on past midnight."""
    first, last = (datetime.date.fromisoformat(d) for d in WEEK)
    state, parts = None, []
    for k in range((last - first).days + 1):
        day = first + datetime.timedelta(days=k)
        events = views.actions(spark, sf_dir, (day.isoformat(), day.isoformat())).drop("keywords")
        until = (day - datetime.date(1970, 1, 1)).days * 86_400 + 86_400
        closed, state = daily.merge_day(events, state or daily.nothing_open(events), until, GAP)
        parts.append(closed)
    parts.append(daily.finish(state, GAP))
    whole = functools.reduce(DataFrame.unionByName, parts)
    return whole.select("guid", "event_id", "session_no", "n_events")


def bucketed_sides(spark: SparkSession, sf_dir: str, buckets: int = 8) -> tuple[DataFrame, DataFrame]:
    """Session events and user histories as tables in buckets by guid."""
    acts = views.actions(spark, sf_dir)
    cut = sessions.sessionize(acts, GAP).select("guid", "session_no", "sec", "event_id")
    logged = acts.select("guid", "domain", "is_click")
    return tuple(
        sources.write_bucketed(side, f"clickpath_{name}_{uuid.uuid4().hex}", ["guid"], buckets, scratch_path(spark, name))
        for name, side in (("sessions", cut), ("histories", logged)))


@query
def bucketed_sessions(spark, sf_dir):
    """Sessions beside their users' histories: both are read, joined and grouped as they lie in their buckets."""
    cut, logged = bucketed_sides(spark, sf_dir)
    lengths = cut.groupBy("guid", "session_no").agg(F.count(F.lit(1)).alias("n_events"))
    supports = logged.groupBy("guid").agg(F.count(F.lit(1)).alias("user_events"), F.sum("is_click").alias("user_clicks"))
    return lengths.join(supports, "guid")


@query
def session_summary(spark, sf_dir):
    return sessions.session_summary(sessions.sessionize(views.actions(spark, sf_dir), GAP))


@query
def sessions_bounded(spark, sf_dir):
    return sessions.bounded_sessions(views.actions(spark, sf_dir), LONG_GAP).select(
        *STEP, "event_id", "n_events")


@query
def sessions_multi_domain(spark, sf_dir):
    cut = sessions.sessionize(views.actions(spark, sf_dir), GAP)
    return sessions.filter_min_distinct(cut).select(*SESSION, "event_id", "domain")


@query
def sessions_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "sessions")
    sources.write_sessions(sessions.bounded_sessions(views.actions(spark, sf_dir), GAP), path)
    return sources.read_sessions(spark, path).select(
        *STEP, "event_id", "sec", "domain", joined("keywords"), "day", r6("dwell").alias("dwell"))


@query
def sessionize_split(spark, sf_dir):
    """The same sessions by the plan for heavy users, with a limit that many users pass."""
    return sessions.sessionize(views.actions(spark, sf_dir), GAP, heavy_rows=50).select(
        "guid", "event_id", "session_no", "n_events")


@query
def pipeline_sessions(spark, sf_dir):
    """From both logs to sessions: users with both sides, users of rare domains out, dwell, sessions of 3 to 20."""
    acts = views.actions(spark, sf_dir)
    both = histories.users_with_both(
        views.daily_cookies(views.impressions(acts)), views.daily_cookies(views.clicks(acts)))
    kept = histories.drop_users_with_rare_domains(both, 8)
    return sessions.bounded_sessions(kept, GAP).select(*STEP, "event_id", "n_events", r6("dwell").alias("dwell"))


@query
def drop_repeats(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return sessions.drop_repeats(views.model_sessions(acts)).select(*STEP, "domain")


@query
def flat_sessions(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    flat = views.stored_sessions(acts)
    numbered = numbering.number_sessions(flat)
    return flat.join(numbered, SESSION).select("session_id", "pos", "domain")


@query
def shuffled_sessions(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return sessions.shuffle_sessions(views.model_sessions(acts), seed=7).select(*STEP, "event_id")


@query
def epoch_batches(spark, sf_dir):
    """Every session's place and batch in the second epoch."""
    flat = views.flat_sessions(views.actions(spark, sf_dir))
    return sessions.epoch_batches(stored(numbering.number_sessions(flat), "numbers"), 2, 128, seed=7).select(
        "session_id", "place", "batch_no")


@query
def sample_sessions(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return sessions.sample_sessions(views.model_sessions(acts), 200, seed=7)


@query
def next_item_pairs(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return sessions.next_item_pairs(views.flat_sessions(acts)).select(*STEP, "domain", "target")


@query
def seen_before(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return sessions.with_seen_before(views.flat_sessions(acts)).select(*STEP, "domain", "seen_before")


# -- runs and context --------------------------------------------------------

def _runs(acts, day_from="own"):
    return context.collapse_runs(
        views.model_sessions(acts), views.merchants(acts), day_from)


def _stored_runs(spark, sf_dir):
    return stored(_runs(views.actions(spark, sf_dir)), "runs")


def _with_means(runs, words):
    means = vectors.domain_keyword_mean(keywords.domain_keywords(runs), words, DIM)
    return vectors.run_keyword_mean(runs, words, means, DIM)


@query
def collapse_runs(spark, sf_dir):
    return _runs(views.actions(spark, sf_dir)).select(
        *RUN, "domain", joined("keywords"), "dwell_bucket", "hour", "day", "is_merchant")


@query
def collapse_runs_boundary_day(spark, sf_dir):
    return _runs(views.actions(spark, sf_dir), "boundary").select(*RUN, "domain", "day")


@query
def dwell_bucket(spark, sf_dir):
    dwell = F.col("dwell")
    bucket = F.when(dwell > 0, half_even(F.log2(dwell)))
    return sessions.with_dwell(views.actions(spark, sf_dir)).select(
        "guid", "event_id", bucket.alias("bucket"), one_hot_slot(bucket, DWELL_SLOTS).alias("slot"))


@query
def hour_of_day_(spark, sf_dir):
    return views.actions(spark, sf_dir).select("event_id", hour_of_day(F.col("sec")).alias("hour"))


REGISTRY["hour_of_day"] = REGISTRY.pop("hour_of_day_")


@query
def context_one_hot(spark, sf_dir):
    sizes = {"dwell_bucket": DWELL_SLOTS, "hour": HOUR_SLOTS, "day": DAY_SLOTS, "is_merchant": KIND_SLOTS}
    places = []
    for name, size in sizes.items():
        vec = one_hot(F.col(name), size)
        places += [(F.array_position(vec, 1.0) - 1).cast("int").alias(f"{name}_slot"),
                   F.size(vec).alias(f"{name}_size")]
    return _runs(views.actions(spark, sf_dir)).select(*RUN, *places)


@query
def context_vector(spark, sf_dir):
    plain, weighted = digest("context")
    return context.with_context_vector(_with_means(_stored_runs(spark, sf_dir), views.keyword_vectors(spark, sf_dir))).select(
        *RUN, F.size("context").alias("dims"), plain.alias("plain_sum"), weighted.alias("weighted_sum"))


@query
def next_context(spark, sf_dir):
    steps = context.as_steps(_runs(views.actions(spark, sf_dir)))
    names = ["domain", "dwell_bucket", "hour", "day", "is_merchant"]
    return sessions.with_next(steps, names).where(F.col("next_domain").isNotNull()).select(
        *STEP, "domain", *[f"next_{n}" for n in names])


# -- vectors -----------------------------------------------------------------

@query
def domain_keywords(spark, sf_dir):
    return keywords.domain_keywords(_runs(views.actions(spark, sf_dir)))


@query
def domain_keyword_mean(spark, sf_dir):
    words = keywords.domain_keywords(_runs(views.actions(spark, sf_dir)))
    means = vectors.domain_keyword_mean(words, views.keyword_vectors(spark, sf_dir), DIM)
    return vectors.long_form(means, ["domain"]).withColumn("value", r6("value"))


@query
def run_keyword_mean(spark, sf_dir):
    plain, weighted = digest("kw_vec")
    return _with_means(_stored_runs(spark, sf_dir), views.keyword_vectors(spark, sf_dir)).select(
        *RUN, "domain", plain.alias("plain_sum"), weighted.alias("weighted_sum"))


@query
def merchant_prior(spark, sf_dir):
    found = views.merchants(views.actions(spark, sf_dir))
    prior = vectors.merchant_prior(found, views.domain_vectors(spark, sf_dir))
    return vectors.long_form(prior, []).withColumn("value", r6("value"))


@query
def domain_vector_lookup(spark, sf_dir):
    acts, vecs = views.actions(spark, sf_dir), views.domain_vectors(spark, sf_dir)
    prior = vectors.merchant_prior(views.merchants(acts), vecs).scalar()
    found = vectors.lookup_vector(keywords.distinct_domains(acts), vecs, prior)
    return vectors.long_form(found, ["domain"]).withColumn("value", r6("value"))


@query
def dictionary_roundtrip(spark, sf_dir):
    """Domain vectors written, and read with the padding key."""
    path = scratch_path(spark, "dictionary")
    sources.write_table(views.domain_vectors(spark, sf_dir), path)
    return vectors.long_form(sources.read_domain_vectors(spark, path, DIM), ["domain"]).select(
        "domain", "dim", r6(F.col("value").cast("double")).alias("value"))


def _visited_vectors(acts, vecs, flat):
    """Flat sessions with the running mean of the visited vectors."""
    prior = vectors.merchant_prior(views.merchants(acts), vecs).scalar()
    return vectors.session_vector(vectors.lookup_vector(flat, vecs, prior))


@query
def session_vector(spark, sf_dir):
    plain, weighted = digest("session_vec")
    acts = views.actions(spark, sf_dir)
    return _visited_vectors(acts, views.domain_vectors(spark, sf_dir), views.flat_sessions(acts)).select(
        *STEP, "domain", plain.alias("plain_sum"), weighted.alias("weighted_sum"))


# -- recommenders ------------------------------------------------------------

@query
def popular_topn(spark, sf_dir):
    return recommend.popularity(views.baskets(spark, sf_dir)).select("candidate", "n", r6("score").alias("score"))


@query
def session_support(spark, sf_dir):
    return recommend.support(views.baskets(spark, sf_dir), ["session"])


@query
def item_cooccurrence(spark, sf_dir):
    return recommend.cooccurrence(views.baskets(spark, sf_dir), ["session"])


@query
def item_knn(spark, sf_dir):
    return recommend.item_knn(views.baskets(spark, sf_dir), ["session"], n_sims=20).select(
        "domain", "other", r6("sim").alias("sim"))


def _steps(test: DataFrame) -> DataFrame:
    return sessions.with_prev(test).withColumn("target", F.col("domain"))


@query
def knn_scores(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    scores = recommend.knn_scores(_steps(test), recommend.item_knn(train, SESSION))
    return scores.withColumn("score", r6("score"))


@query
def session_popular_scores(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    scores = recommend.session_popular_scores(test, recommend.popularity(train))
    return scores.withColumn("score", r6("score"))


@query
def recommend_topk(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    scores = recommend.session_popular_scores(test, recommend.popularity(train))
    return recommend.recommend(scores, 5).withColumn("score", r6("score"))


@query
def recommend_by_kind(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    vocab = numbering.vocabulary(train, views.merchants(acts))
    scores = recommend.session_popular_scores(test, recommend.popularity(train))
    return recommend.recommend_by_kind(scores, vocab, 3).withColumn("score", r6("score"))


def _vector_sides(acts, vecs, train, test):
    """Steps with the mean of the vectors visited before them, and the items."""
    visited = _visited_vectors(acts, vecs, test)
    steps = sessions.next_item_pairs(visited).select(*STEP, "target", F.col("session_vec").alias("query"))
    return steps, scoring.vector_items(_vocab(acts, train), vecs)


@query
def session_vector_scores(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    steps, items = _vector_sides(acts, views.domain_vectors(spark, sf_dir), train, test)
    return scoring.top_scores(steps, items, scoring.dot_scorer, 10).select(
        *STEP, "candidate", r6("score").alias("score"), "place")


@query
def random_scores(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    vocab = _vocab(acts, train)
    return models.random_scores(_steps(test).select(*STEP), vocab, 10, seed=7).select(
        *STEP, "candidate", r6("score").alias("score"), "place")


# -- split and evaluation ----------------------------------------------------

@query
def train_test_split(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    dated = recommend.with_start(views.flat_sessions(acts))
    return recommend.with_side(dated, TEST_FROM).select("side", *STEP, "domain")


@query
def train_test_tail(spark, sf_dir):
    """The last 100 sessions for test, 50 before them left out."""
    acts = views.actions(spark, sf_dir)
    flat = views.stored_sessions(acts)
    train, test = recommend.split_tail(flat, numbering.number_sessions(flat), 100, 50)
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.select("side", "session_id", "pos", "domain")


@query
def test_known_domains(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return views.split(acts)[1].select(*STEP, "domain")


@query
def common_domains(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    flat = views.stored_sessions(acts)
    return keywords.common_domains(*recommend.split_by_start(flat, TEST_FROM))


@query
def eval_steps(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return _steps(views.split(acts)[1]).select(*STEP, "prev", "target")


def _vocab(acts, train):
    return numbering.vocabulary(train, views.merchants(acts))


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes])


def _knn_ranks(spark, sf_dir, last_only=False):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    test = sessions.with_seen_before(test)
    steps = _steps(test)
    if last_only:
        steps = sessions.last_step_only(steps)
    lists = recommend.neighbour_lists(recommend.item_knn(train, SESSION))
    return evaluate.target_rank(steps, lists, _vocab(acts, train), ["prev"])


def _session_popular_ranks(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    scores = recommend.session_popular_scores(test, recommend.popularity(train))
    return evaluate.target_rank(_steps(sessions.with_seen_before(test)), scores, _vocab(acts, train))


@query
def eval_popular(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    ranks = evaluate.global_target_rank(
        _steps(test), recommend.popularity(train).select("candidate", "score"), _vocab(acts, train))
    return _rounded(evaluate.ranking_metrics(ranks))


@query
def eval_session_popular(spark, sf_dir):
    return _rounded(evaluate.ranking_metrics(_session_popular_ranks(spark, sf_dir)))


@query
def eval_knn(spark, sf_dir):
    return _rounded(evaluate.ranking_metrics(_knn_ranks(spark, sf_dir)))


@query
def eval_last_step(spark, sf_dir):
    return _rounded(evaluate.ranking_metrics(_knn_ranks(spark, sf_dir, last_only=True)))


@query
def eval_ranks(spark, sf_dir):
    """The rank behind the KNN metrics, step by step."""
    return _knn_ranks(spark, sf_dir).select(*STEP, "prev", "target", "rank")


@query
def eval_topk_mode(spark, sf_dir):
    return _rounded(evaluate.ranking_metrics(_knn_ranks(spark, sf_dir), strict=False, full_mrr=True))


@query
def eval_by_target_kind(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    vocab = _vocab(acts, views.split(acts)[0])
    return _rounded(evaluate.metrics_by_kind(_session_popular_ranks(spark, sf_dir), vocab))


@query
def eval_by_history(spark, sf_dir):
    return _rounded(evaluate.ranking_metrics(
        _session_popular_ranks(spark, sf_dir), strict=False, full_mrr=True, by=["seen_before"]))


@query
def eval_by_position(spark, sf_dir):
    return _rounded(evaluate.metrics_by_position(_session_popular_ranks(spark, sf_dir)))


@query
def eval_batch_mean(spark, sf_dir):
    return _rounded(evaluate.batch_means(stored(_session_popular_ranks(spark, sf_dir), "ranks")))


@query
def eval_random(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    steps, items = models.random_sides(_steps(test), _vocab(acts, train), seed=7)
    return _rounded(evaluate.ranking_metrics(scoring.dense_target_rank(steps, items, scoring.random_scorer)))


@query
def eval_session_vector(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    steps, items = _vector_sides(acts, views.domain_vectors(spark, sf_dir), train, test)
    return _rounded(evaluate.ranking_metrics(scoring.dense_target_rank(steps, items, scoring.dot_scorer)))


@query
def vector_ranks_with_ties(spark, sf_dir):
    """Ranks among all domains, those without a vector at the prior: equal vectors tie. Merchants have a bias."""
    acts, vecs = views.actions(spark, sf_dir), views.domain_vectors(spark, sf_dir)
    train, test = views.split(acts)
    steps, _ = _vector_sides(acts, vecs, train, test)
    vocab = _vocab(acts, train)
    filled = vectors.lookup_vector(vocab.select("domain"), vecs, vectors.merchant_prior(views.merchants(acts), vecs).scalar())
    items = scoring.vector_items(vocab, filled, F.col("is_merchant") * 0.25)
    return scoring.dense_target_rank(steps, items, scoring.dot_scorer)


def _shuffled_ranks(spark, sf_dir):
    """Control: ranks of the same recommender on sessions in random order, and the vocabulary."""
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    shuffled = sessions.with_seen_before(sessions.shuffle_sessions(test, seed=7))
    scores = recommend.session_popular_scores(shuffled, recommend.popularity(train))
    vocab = _vocab(acts, train)
    return evaluate.target_rank(_steps(shuffled), scores, vocab), vocab


@query
def eval_shuffled(spark, sf_dir):
    return _rounded(evaluate.ranking_metrics(_shuffled_ranks(spark, sf_dir)[0], strict=False, full_mrr=True))


@query
def eval_shuffled_by_kind(spark, sf_dir):
    return _rounded(evaluate.metrics_by_kind(*_shuffled_ranks(spark, sf_dir)))


@query
def eval_shuffled_by_history(spark, sf_dir):
    return _rounded(evaluate.ranking_metrics(
        _shuffled_ranks(spark, sf_dir)[0], strict=False, full_mrr=True, by=["seen_before"]))


@query
def eval_batch_mean_whole(spark, sf_dir):
    """Per-batch means without the incomplete last batch."""
    return _rounded(evaluate.batch_means(stored(_session_popular_ranks(spark, sf_dir), "ranks"), whole_only=True))


@query
def loss_cross_entropy(spark, sf_dir):
    return _loss(spark, sf_dir, evaluate.cross_entropy)


@query
def loss_bpr_max(spark, sf_dir):
    return _loss(spark, sf_dir, evaluate.bpr_max)


def _loss(spark, sf_dir, loss):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    scores = recommend.session_popular_scores(test, recommend.popularity(train))
    return _rounded(loss(scores, _steps(test), _vocab(acts, train)))


def _dense_loss(spark, sf_dir, loss):
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    steps, items = _vector_sides(acts, views.domain_vectors(spark, sf_dir), train, test)
    return _rounded(loss(steps, items, scoring.dot_scorer))


@query
def loss_cross_entropy_dense(spark, sf_dir):
    """Over the scores of all domains with a vector, negative ones too."""
    return _dense_loss(spark, sf_dir, losses.cross_entropy_dense)


@query
def loss_bpr_max_dense(spark, sf_dir):
    return _dense_loss(spark, sf_dir, losses.bpr_max_dense)


@query
def vector_block_share(spark, sf_dir):
    """How many blocks of 8 domains the norm bounds leave to each target's rank, over all steps."""
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    steps, items = _vector_sides(acts, views.domain_vectors(spark, sf_dir), train, test)
    blocks = scoring.in_blocks(items, scoring.dot_scorer, 8)
    known = scoring.with_own_score(steps, items, scoring.dot_scorer)
    reached = scoring.with_reach(known, blocks, scoring.dot_scorer, F.col("own_score"))
    return scoring.block_share(reached, blocks)


# -- models ------------------------------------------------------------------

def _folded_metrics(acts, train, test, vecs, dim):
    """Metrics of sessions folded into the factors of the domains."""
    folded = factors.fold_in(test.select(*STEP, "domain"), vecs, dim)
    steps = sessions.next_item_pairs(folded).select(*STEP, "target", "query")
    items = scoring.vector_items(_vocab(acts, train), vecs)
    return _rounded(evaluate.ranking_metrics(scoring.dense_target_rank(steps, items, scoring.dot_scorer)))


@query
def eval_factors(spark, sf_dir):
    """Sessions folded into the first three numbers of the domains' vectors."""
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    vecs = views.domain_vectors(spark, sf_dir).select("domain", F.slice("vec", 1, 3).alias("vec"))
    return _folded_metrics(acts, train, test, vecs.join(train.select("domain").distinct(), "domain", "left_semi"), 3)


@query
def eval_als(spark, sf_dir):
    """The same with factors learned from the training sessions."""
    acts = views.actions(spark, sf_dir)
    train, test = views.split(acts)
    learned = stored(models.item_factors(train, factors=16, iterations=5), "factors")
    return _folded_metrics(acts, train, test, learned, 16)


@query
def word2vec_corpus(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return models.word2vec_corpus(views.model_sessions(acts)).select(*SESSION, joined("tokens"))


@query
def domain_vectors(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    found = models.domain_vectors(models.word2vec_corpus(views.model_sessions(acts)))
    return found.select("domain", F.size("vec").alias("dims"))


@query
def ppmi_pairs(spark, sf_dir):
    """The weights that the vectors are made from."""
    flat = views.model_sessions(views.actions(spark, sf_dir))
    return cofactors.ppmi(cofactors.window_pairs(flat)).select("domain", "context", r6("value").alias("value"))


@query
def domain_vectors_ppmi(spark, sf_dir):
    """Vectors of the domains from the company that they keep in sessions."""
    flat = views.model_sessions(views.actions(spark, sf_dir))
    found = stored(cofactors.pair_factors(cofactors.ppmi(cofactors.window_pairs(flat)), size=16), "vectors")
    return found.select("domain", F.size("vec").alias("dims"))


@query
def training_examples_learned(spark, sf_dir):
    """Training rows whose domain vectors are learned from the training sessions' own pairs."""
    acts = views.actions(spark, sf_dir)
    runs, found = _stored_runs(spark, sf_dir), views.merchants(acts)
    flat = views.model_sessions(acts)
    learned = stored(cofactors.pair_factors(cofactors.ppmi(cofactors.window_pairs(flat)), size=16), "vectors")
    steps = context.as_steps(context.with_context_vector(_with_means(runs, views.keyword_vectors(spark, sf_dir))))
    rows = models.training_examples(
        steps, learned, vectors.merchant_prior(found, learned).scalar(), numbering.vocabulary(runs, found))
    return rows.select(*STEP, "target", "target_idx", "target_is_merchant", "seen_before",
                       F.size("input_vec").alias("input_dims"))


@query
def item_factors_als(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return models.item_factors(views.flat_sessions(acts)).select("domain", F.size("vec").alias("dims"))


@query
def negative_samples(spark, sf_dir):
    acts = views.actions(spark, sf_dir)
    return models.negative_samples(views.flat_sessions(acts), seed=7)


@query
def training_examples(spark, sf_dir):
    acts, vecs = views.actions(spark, sf_dir), views.domain_vectors(spark, sf_dir)
    runs, found = _stored_runs(spark, sf_dir), views.merchants(acts)
    steps = context.as_steps(context.with_context_vector(
        _with_means(runs, views.keyword_vectors(spark, sf_dir))))
    rows = models.training_examples(
        steps, vecs, vectors.merchant_prior(found, vecs).scalar(), numbering.vocabulary(runs, found))
    given, following = digest("input_vec"), digest("next_context")
    return rows.select(
        *STEP, "target", "target_idx", "target_is_merchant", "seen_before",
        F.size("input_vec").alias("input_dims"),
        given[0].alias("input_sum"), given[1].alias("input_weighted"),
        following[0].alias("next_sum"), following[1].alias("next_weighted"))
