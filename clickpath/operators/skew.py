"""Splitting heavy keys.

A window over one key runs in one task, so a key that holds a large part of
all rows has to be cut into pieces first. Pieces have about the same number of
rows at any data size. The list of heavy keys is a stored table: at most one
row per HEAVY_ROWS rows, joined as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickpath.runtime import stored

HEAVY_ROWS = 5_000_000


def heavy_keys(df: DataFrame, keys: list[str], heavy_rows: int = HEAVY_ROWS,
               measures: tuple[str, ...] = ()) -> DataFrame | None:
    """The heavy keys with ``_rows`` (their row count), ``_limit`` (the count
    above which a key is heavy) and further ``measures``; None if there are
    none, so that callers can leave out the steps for heavy keys.

    Looks at the data: one aggregation by key, whose heavy rows are stored.
    """
    stats = df.groupBy(*keys).agg(F.expr("count(1) AS _rows"), *[F.expr(m) for m in measures])
    heavy = stored(stats.where(F.col("_rows") > heavy_rows)
                   .withColumn("_limit", F.lit(heavy_rows).cast("bigint")), "heavy")
    return None if heavy.isEmpty() else heavy


def without_heavy(df: DataFrame, keys: list[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """df less the rows of its heavy keys."""
    heavy = heavy_keys(df, keys, heavy_rows)
    return df if heavy is None else df.join(heavy, keys, "left_anti")


def in_blocks(df: DataFrame, key: str, at: str, heavy_rows: int = HEAVY_ROWS) -> tuple[DataFrame, bool]:
    """Shuffle df by (key, _block), heavy keys cut into blocks along time; also
    tells whether there are any.

    Light keys have the single block 0. Of a heavy key, the rows per second are
    counted and running totals of these counts cut its time line into blocks
    of about the limit, however unevenly the rows lie; a block ends between
    two seconds, so one key's rows of the same second stay together. ``_rows,
    _first, _last`` give a heavy key's row count and time range, else null.
    """
    heavy = heavy_keys(df, [key], heavy_rows, (f"min({at}) AS _first", f"max({at}) AS _last"))
    if heavy is None:
        return df.selectExpr(*df.columns, *_LIGHT).repartition(key), False
    light_rows = df.join(heavy, key, "left_anti").selectExpr(*df.columns, *_LIGHT)
    own_rows = df.join(heavy, key)
    before = f"sum(_n) OVER (PARTITION BY {key} ORDER BY {at}) - _n"
    cuts = (
        own_rows.groupBy(key, at, "_limit").agg(F.expr("count(1) AS _n"))
        .selectExpr(key, at, f"floor(({before}) / _limit) AS _block"))
    # stored: the lists carried from block to block read these rows again
    cut_rows = stored(own_rows.join(cuts, [key, at]).select(*light_rows.columns), "blocks")
    return light_rows.unionByName(cut_rows).repartition(key, "_block"), True


BLOCK_COLUMNS = ["_block", "_rows", "_first", "_last"]
_LIGHT = ["0L AS _block", "cast(NULL AS bigint) AS _rows", "cast(NULL AS bigint) AS _first",
          "cast(NULL AS bigint) AS _last"]
