"""Dwell times, gap sessions and the shape of a session."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from clickpath.functions.columns import seeded_number
from clickpath.operators.skew import BLOCK_COLUMNS, HEAVY_ROWS, in_blocks, without_heavy
from clickpath.runtime import stored
from clickpath.schema import DOMAIN, ORDER, SESSION, TIME, USER

FEISTEL_ROUNDS = 3

IN_BLOCK = f"PARTITION BY {USER}, _block ORDER BY {', '.join(ORDER)}"
WHOLE_BLOCK = f"PARTITION BY {USER}, _block"
BY_BLOCK = f"PARTITION BY {USER} ORDER BY _block"
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _by_pos():
    return Window.partitionBy(*SESSION).orderBy("pos")


def with_dwell(events: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Adds ``dwell``, the seconds to the user's next event.

    A user's last event gets the mean of the user's other dwells; it is null
    for a user with one event.
    """
    blocks, heavy = in_blocks(events, USER, TIME, heavy_rows)
    edges = _block_edges(blocks, gap=0) if heavy else None
    return _dwell(blocks, edges).select(*events.columns, "dwell")


def sessionize(events: DataFrame, gap: int = 1800, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Adds ``dwell``, ``session_no`` (0-based per user) and ``n_events``.

    A dwell above ``gap`` seconds ends the session after that event. One
    shuffle by user serves all of it; the windows of the session numbers and
    lengths run on the same partitioning. Users above ``heavy_rows`` events are
    cut into blocks; one user's events of the same second stay in one block.
    """
    blocks, heavy = in_blocks(events, USER, TIME, heavy_rows)
    numbered = _dwell(blocks, _block_edges(blocks, gap) if heavy else None).selectExpr(
        *events.columns, *BLOCK_COLUMNS, "dwell",
        f"""coalesce(sum(if(dwell > {gap}, 1L, 0L)) OVER ({IN_BLOCK} {EARLIER}), 0)
            + coalesce(_offset, 0) AS session_no""")
    kept = [*events.columns, "dwell", "session_no"]
    in_block = f"count(1) OVER (PARTITION BY {USER}, _block, session_no)"
    if not heavy:
        return numbered.selectExpr(*kept, f"{in_block} AS n_events")
    return (
        numbered.selectExpr(*kept, f"{in_block} AS _n")
        .join(_sessions_across_blocks(numbered), SESSION, "left")
        .selectExpr(*kept, "coalesce(_total, _n) AS n_events")
    )


def _block_edges(blocks: DataFrame, gap: int) -> DataFrame:
    """Per block of a heavy user: when the next block starts, and how many
    session breaks lie before the block."""
    steps = blocks.where("_rows IS NOT NULL").selectExpr(
        USER, "_block", TIME, f"lead({TIME}) OVER ({IN_BLOCK}) - {TIME} > {gap} AS _break")
    return (
        steps.groupBy(USER, "_block")
        .agg(F.expr(f"min({TIME}) AS _start"), F.expr(f"max({TIME}) AS _end"),
             F.expr("count_if(_break) AS _breaks"))
        .selectExpr("*", f"lead(_start) OVER ({BY_BLOCK}) AS _next")
        .selectExpr(USER, "_block", "_next",
                    f"sum(_breaks + if(_next - _end > {gap}, 1, 0)) OVER ({BY_BLOCK} {EARLIER}) AS _offset")
    )


def _dwell(blocks: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Adds ``dwell``. The gaps of a user add up to the whole time range, which
    gives their mean."""
    window = f"OVER ({WHOLE_BLOCK})"
    if edges is None:
        edged = blocks.selectExpr("*", "cast(NULL AS bigint) AS _next", "0L AS _offset")
    else:
        edged = blocks.join(edges, [USER, "_block"], "left")
    return (
        edged.selectExpr(
            *blocks.columns, "_offset",
            f"coalesce(lead({TIME}) OVER ({IN_BLOCK}), _next) - {TIME} AS _step",
            f"coalesce(_last - _first, max({TIME}) {window} - min({TIME}) {window}) AS _range",
            f"coalesce(_rows, count(1) {window}) AS _count")
        .selectExpr(*blocks.columns, "_offset",
                    "coalesce(cast(_step AS double), try_divide(_range, _count - 1)) AS dwell")
    )


def _sessions_across_blocks(numbered: DataFrame) -> DataFrame:
    """Lengths of heavy users' sessions that cross a block edge: at most one
    per edge."""
    return (
        numbered.where("_rows IS NOT NULL").groupBy(*SESSION)
        .agg(F.expr("count(1) AS _total"), F.expr("min(_block) AS _from"), F.expr("max(_block) AS _to"))
        .where("_from < _to").select(*SESSION, "_total")
    )


def session_summary(sessions: DataFrame) -> DataFrame:
    """One row per session; partial aggregation keeps long sessions cheap."""
    place = F.struct(*ORDER)
    return sessions.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(TIME).alias("start_sec"),
        F.max(TIME).alias("end_sec"),
        F.min_by(DOMAIN, place).alias("first_domain"),
        F.max_by(DOMAIN, place).alias("last_domain"),
        F.sum("is_click").alias("n_clicks"),
    )


def bounded_sessions(events: DataFrame, gap: int = 1800, min_len: int = 3, max_len: int = 20,
                     heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Sessions of min_len to max_len events, with ``pos`` in the session.

    From here on a session is at most max_len rows, so windows over one are
    small whoever the user is.
    """
    kept = sessionize(events, gap, heavy_rows).where(F.col("n_events").between(min_len, max_len))
    return with_pos(kept)


def with_pos(sessions: DataFrame) -> DataFrame:
    place = Window.partitionBy(*SESSION).orderBy(*ORDER)
    return sessions.withColumn("pos", F.row_number().over(place) - 1)


def filter_session_length(df: DataFrame, keys: list[str], min_len: int = 3, max_len: int = 20,
                          heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Keep the groups of min_len to max_len rows, for tables that come with a
    session key. Heavy groups are too long anyway and go before the shuffle."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    fitting = sizes.where(F.col("_n").between(min_len, max_len)).select(*keys)
    return without_heavy(df, keys, max(heavy_rows, max_len)).join(fitting, keys, "left_semi")


def filter_min_distinct(sessions: DataFrame, least: int = 2) -> DataFrame:
    """Sessions with at least ``least`` different domains."""
    varied = (sessions.groupBy(*SESSION).agg(F.count_distinct(DOMAIN).alias("_kinds"))
              .where(F.col("_kinds") >= least).select(*SESSION))
    return sessions.join(varied, SESSION, "left_semi")


def multi_domain(bounded: DataFrame, least: int = 2) -> DataFrame:
    """The same for length-bounded sessions: a window on the session's own
    partitioning, no join."""
    kinds = F.size(F.collect_set(DOMAIN).over(Window.partitionBy(*SESSION)))
    return bounded.withColumn("_kinds", kinds).where(F.col("_kinds") >= least).drop("_kinds")


def drop_repeats(bounded: DataFrame) -> DataFrame:
    """Remove consecutive repeats of a domain and number the rest."""
    earlier = F.lag(DOMAIN).over(_by_pos())
    kept = bounded.withColumn("_earlier", earlier).where(
        F.col("_earlier").isNull() | (F.col("_earlier") != F.col(DOMAIN)))
    return kept.withColumn("pos", F.row_number().over(_by_pos()) - 1).drop("_earlier")


def next_item_pairs(sessions: DataFrame) -> DataFrame:
    """Input and target of every step but the last; ``pos`` counts from 0."""
    return sessions.withColumn("target", F.lead(DOMAIN).over(_by_pos())).where(
        F.col("target").isNotNull())


def with_next(sessions: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>``: the context of the step's target."""
    for name in columns:
        sessions = sessions.withColumn(f"next_{name}", F.lead(name).over(_by_pos()))
    return sessions


def with_seen_before(sessions: DataFrame) -> DataFrame:
    """``seen_before``: 1 if the session has visited this row's domain already."""
    visit = F.row_number().over(Window.partitionBy(*SESSION, DOMAIN).orderBy("pos"))
    return sessions.withColumn("seen_before", (visit > 1).cast("int"))


def with_prev(sessions: DataFrame) -> DataFrame:
    """Steps to predict: the query item is the previous domain, so the first
    row of a session is never predicted."""
    return sessions.withColumn("prev", F.lag(DOMAIN).over(_by_pos())).where(F.col("prev").isNotNull())


def last_step_only(sessions: DataFrame) -> DataFrame:
    last = F.max("pos").over(Window.partitionBy(*SESSION))
    return sessions.withColumn("_last", last).where(F.col("pos") == F.col("_last")).drop("_last")


def seeded_text(seed: int, columns: list[str]):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def shuffle_sessions(sessions: DataFrame, seed: int = 0) -> DataFrame:
    """Random order inside each session, the same for the same seed."""
    order = Window.partitionBy(*SESSION).orderBy("_order", "pos")
    return (sessions.withColumn("_order", seeded_text(seed, [*SESSION, "pos"]))
            .withColumn("pos", F.row_number().over(order) - 1).drop("_order"))


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """All rows in a random order that the seed fixes."""
    return df.orderBy(seeded_text(seed, keys), *keys)


def sample_sessions(sessions: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A random draw of n sessions: the first n of the shuffled order."""
    return shuffle_rows(sessions.select(*SESSION).distinct(), SESSION, seed).limit(n)


def epoch_batches(numbered: DataFrame, epoch: int, batch: int, seed: int = 0, number: str = "session_id",
                  first: int = 1) -> DataFrame:
    """Adds ``place`` and ``batch_no``: each session's 0-based place in the order of an epoch.

    The order is a permutation of the dense session numbers that a Feistel
    network, keyed by seed and epoch, computes from each number: nothing is
    sorted, any batch can be read alone, and every epoch has another order.
    Numbers lie in a grid of about sqrt(n) rows and columns with fewer than
    sqrt(n) cells over; a place in these goes through the network again until
    it is one of the n, so places are dense too.
    """
    n = numbered.count()
    rows = max(1, math.isqrt(max(n - 1, 0)) + 1)
    columns = max(1, -(-n // rows))

    def network(x):
        left, right = F.floor(x / columns).cast("long"), x % columns
        for k in range(FEISTEL_ROUNDS):
            left = (left + seeded_number(seed, F.lit(epoch), F.lit(2 * k), right) % rows) % rows
            right = (right + seeded_number(seed, F.lit(epoch), F.lit(2 * k + 1), left) % columns) % columns
        return left * columns + right

    done, rest = None, numbered.withColumn("place", (F.col(number) - first).cast("long"))
    while True:
        moved = stored(rest.withColumn("place", network(F.col("place"))), "places")
        inside = moved.where(F.col("place") < n)
        done = inside if done is None else done.unionByName(inside)
        rest = moved.where(F.col("place") >= n)
        if rest.isEmpty():
            return done.withColumn("batch_no", F.floor(F.col("place") / batch))
