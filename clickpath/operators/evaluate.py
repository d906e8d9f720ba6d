"""Ranks of the true next domain, metrics over them, and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clickpath.functions.columns import clean_score, sigmoid
from clickpath.operators.numbering import number_sessions
from clickpath.schema import DOMAIN, SESSION, STEP


def target_rank(steps: DataFrame, scores: DataFrame, vocab: DataFrame, query: list[str] = STEP) -> DataFrame:
    """Adds ``rank``: 1 + the training domains that score above the target,
    ties to the lower idx; null if the target is not a training domain.

    ``scores`` is sparse, its query columns tell which list a step uses. A rank
    depends on the list and the target alone, so it is worked out once per
    distinct pair: where many steps share a list, they meet it once.
    Unlisted domains score 0; how many of them lie before the target follows
    from its idx, so they need no rows.
    """
    listed = scores.join(
        vocab.select(F.col(DOMAIN).alias("candidate"), F.col("idx").alias("_c")), "candidate"
    ).select(*query, "_c", clean_score(F.col("score").cast("double")).alias("_s"))
    pairs = steps.select(*query, "target").distinct().join(
        vocab.select(F.col(DOMAIN).alias("target"), F.col("idx").alias("_t")), "target")
    pair = [*query, "target"]
    size = vocab.agg(F.count(F.lit(1))).scalar()
    c, t, s, own = (F.col(name) for name in ("_c", "_t", "_s", "_own"))
    listed_before = F.count_if(c < t)
    unlisted = (F.when(F.first(own) > 0, 0)
                .when(F.first(own) < 0, size - F.count(c))
                .otherwise(F.first(t) - listed_before))
    ranks = (
        pairs.join(listed, query, "left")
        .withColumn("_own", F.coalesce(
            F.max(F.when(c == t, s)).over(Window.partitionBy(*pair)), F.lit(0.0)))
        .groupBy(*pair)
        .agg((1 + F.count_if(s > own) + F.count_if((s == own) & (c < t)) + unlisted).alias("rank"))
    )
    return steps.join(ranks, pair, "left")


def global_target_rank(steps: DataFrame, scores: DataFrame, vocab: DataFrame) -> DataFrame:
    """target_rank for one short score list that serves every step (a top_n).

    The list rides along as an array, ranks are worked out once per target.
    """
    listed = scores.join(vocab.select(F.col(DOMAIN).alias("candidate"), F.col("idx").alias("c")), "candidate")
    as_array = listed.select(F.struct("c", clean_score(F.col("score").cast("double")).alias("s")).alias("e")).agg(
        F.collect_list("e")).scalar()
    size = vocab.agg(F.count(F.lit(1))).scalar()
    ranks = (
        vocab.select(F.col(DOMAIN).alias("target"), F.col("idx").alias("t"), as_array.alias("l"), size.alias("v"))
        .selectExpr("target", "t", "l", "v", "coalesce(get(filter(l, e -> e.c = t), 0).s, 0D) AS own")
        .selectExpr("target", """
            1L + size(filter(l, e -> e.s > own OR (e.s = own AND e.c < t)))
            + CASE WHEN own > 0 THEN 0 WHEN own < 0 THEN v - size(l)
                   ELSE t - size(filter(l, e -> e.c < t)) END AS rank""")
    )
    return steps.join(ranks, "target", "left")


def ranking_metrics(ranks: DataFrame, k: int = 10, strict: bool = True, full_mrr: bool = False,
                    by: list[str] | None = None) -> DataFrame:
    """n, recall, mrr, accuracy: over all rows or per ``by`` group.

    strict: a hit is rank < k, else rank <= k. full_mrr: every rank adds its
    reciprocal, else only hits do. A null rank is a miss that counts in n.
    """
    rank = F.col("rank")
    hit = F.coalesce(rank < k if strict else rank <= k, F.lit(False))
    gain = 1.0 / rank
    n = F.count(F.lit(1))
    return ranks.groupBy(*(by or [])).agg(
        n.alias("n"),
        (F.count_if(hit) / n).alias("recall"),
        (F.coalesce(F.sum(gain if full_mrr else F.when(hit, gain)), F.lit(0.0)) / n).alias("mrr"),
        (F.count_if(hit & (rank == 1)) / n).alias("accuracy"),
    )


def metrics_by_kind(ranks: DataFrame, vocab: DataFrame, k: int = 10) -> DataFrame:
    """Metrics per kind of the target, as the vocabulary flags it (``is_merchant``;
    null for targets outside the vocabulary)."""
    kinds = vocab.select(F.col(DOMAIN).alias("target"), "is_merchant")
    return ranking_metrics(ranks.drop("is_merchant").join(kinds, "target", "left"), k,
                           strict=False, full_mrr=True, by=["is_merchant"])


def metrics_by_position(ranks: DataFrame, max_len: int = 19, k: int = 10) -> DataFrame:
    """Recall per position of the prediction (0-based): every position that
    occurs, and those below ``max_len`` where none fell with 0."""
    found = ranking_metrics(ranks.withColumn("position", F.col("pos") - 1), k, strict=False, by=["position"])
    places = ranks.sparkSession.range(max_len).select(F.col("id").cast("int").alias("position"))
    return places.join(found, "position", "full").select(
        "position", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def batch_means(ranks: DataFrame, batch: int = 128, k: int = 10, whole_only: bool = False) -> DataFrame:
    """Means of per-batch metrics, a batch being ``batch`` sessions in order.

    whole_only drops an incomplete last batch.
    """
    numbered = number_sessions(ranks, first=0, name="_no")
    placed = ranks.join(numbered, SESSION).withColumn("batch_no", F.floor(F.col("_no") / batch))
    if whole_only:
        last = numbered.agg(F.floor((F.max("_no") + 1) / batch)).scalar()
        placed = placed.where(F.col("batch_no") < last)
    per_batch = ranking_metrics(placed, k, strict=False, full_mrr=True, by=["batch_no"])
    return per_batch.agg(F.count(F.lit(1)).alias("batches"), F.avg("recall").alias("recall"),
                         F.avg("mrr").alias("mrr"), F.avg("accuracy").alias("accuracy"))


def drop_last_step(steps: DataFrame) -> DataFrame:
    """Leave the very last test step out of the evaluation."""
    last = steps.agg(F.max(F.struct(*STEP))).scalar()
    return steps.where(F.struct(*STEP) < last)


def _of_step():
    return Window.partitionBy(*STEP)


def _with_target_score(scores: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows of a step's list (or one empty row), with the target's score."""
    joined = steps.select(*STEP, "target").join(scores, STEP, "left")
    own = F.max(F.when(F.col("candidate") == F.col("target"), F.col("score"))).over(_of_step())
    return joined.withColumn("own", F.coalesce(own, F.lit(0.0)))


def cross_entropy(scores: DataFrame, steps: DataFrame, vocab: DataFrame) -> DataFrame:
    """(n, loss): mean softmax cross-entropy of the target over all domains.

    Unlisted domains have score 0 and enter the sum by their number.
    """
    size = vocab.agg(F.count(F.lit(1))).scalar()
    s, top = F.col("score"), F.col("top")
    # 0 joins the maximum; subtracting any upper bound keeps the sum exact
    rows = _with_target_score(scores, steps).withColumn(
        "top", F.greatest(F.coalesce(F.max("score").over(_of_step()), F.lit(0.0)), F.lit(0.0)))
    unlisted = size - F.count(s)
    total = F.coalesce(F.sum(F.exp(s - top)), F.lit(0.0)) + unlisted * F.exp(-F.first(top))
    per_step = rows.groupBy(*STEP).agg((F.log(total) + F.first(top) - F.first("own")).alias("loss"))
    return per_step.agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"))


def bpr_max(scores: DataFrame, steps: DataFrame, vocab: DataFrame, n: int | None = None,
            lmbda: float = 1.0) -> DataFrame:
    """(n, loss): mean BPR-max over the n highest scores of each step.

    n defaults to a third of the vocabulary; the target may be among them.
    Unlisted domains stand at 0, between positive and negative scores.
    """
    size = vocab.agg(F.count(F.lit(1))).scalar()
    take = F.floor(size / 3) if n is None else F.lit(n)
    s, own, top = F.col("score"), F.col("own"), F.col("top")
    ordered = Window.partitionBy(*STEP).orderBy(s.desc_nulls_last(), "candidate")
    rows = (
        _with_target_score(scores, steps)
        .withColumn("unlisted", size - F.count(s).over(_of_step()))
        .withColumn("at_least_0", F.count_if(s >= 0).over(_of_step()))
        .withColumn("top", F.greatest(F.coalesce(F.max(s).over(_of_step()), F.lit(0.0)), F.lit(0.0)))
        .withColumn("place", F.row_number().over(ordered) + F.when(s < 0, F.col("unlisted")).otherwise(0))
        .withColumn("zeros", F.greatest(F.lit(0), F.least(take - F.col("at_least_0"), F.col("unlisted"))))
    )
    inside = F.col("place") <= take
    weight = F.when(inside, F.exp(s - top))
    zeros, zero_weight = F.first("zeros"), F.exp(-F.first(top))

    def total(part):
        return F.coalesce(F.sum(part), F.lit(0.0))

    norm = total(weight) + zeros * zero_weight
    active = total(weight * sigmoid(own - s)) + zeros * zero_weight * sigmoid(F.first(own))
    squares = total(weight * s * s)
    per_step = rows.groupBy(*STEP).agg(
        (-F.log(active / norm) + lmbda * squares / norm).alias("loss"))
    return per_step.agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"))
