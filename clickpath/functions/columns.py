"""Scalar expressions: time slots, one-hot vectors, scores, seeded numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Slot counts of the context one-hot vectors
DWELL_SLOTS = 20
HOUR_SLOTS = 24
DAY_SLOTS = 31
KIND_SLOTS = 2

# a prime below 2^31, so that products of two residues fit in 64 bits
PRIME = 2_147_483_647


def hour_of_day(sec: Column) -> Column:
    return (F.floor(sec / 3600) % 24).cast("int")


def mean_log2(dwell: Column) -> Column:
    """Aggregate: mean of log2(dwell); null as soon as one dwell has no
    logarithm (a zero dwell would pull the mean to minus infinity)."""
    no_log = F.max(F.when(dwell > 0, 0).otherwise(1))
    return F.when(no_log == 0, F.avg(F.log2(dwell)))


def half_even(value: Column) -> Column:
    """Round to the nearest integer, halves to even; noise below 1e-9 is cut
    first so that an exact half stays one (2.4999999999 counts as 2.5)."""
    return F.rint(F.round(value, 9)).cast("int")


def one_hot_slot(value: Column, size: int) -> Column:
    """The index a one-hot vector sets: value cut to an integer, negative ones
    counted from the end, everything without a place in slot 0."""
    number = value.cast("double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    # NaN sorts above every number, so the range test also turns it away
    return (
        F.when((number >= size) | (number <= -size - 1) | number.isNull(), 0)
        .when(whole < -size, 0)
        .when(whole < 0, whole + size)
        .otherwise(whole)
        .cast("int")
    )


def one_hot(value: Column, size: int) -> Column:
    slot = one_hot_slot(value, size)
    return F.concat(
        F.array_repeat(F.lit(0.0), slot),
        F.array(F.lit(1.0)),
        F.array_repeat(F.lit(0.0), F.lit(size - 1) - slot),
    )


def support_score(n: Column) -> Column:
    return n / (n + 1)


def similarity_norm(support_i: Column, support_j: Column, lmbd: float = 20, alpha: float = 0.5) -> Column:
    norm = F.pow(support_i + lmbd, F.lit(float(alpha))) * F.pow(support_j + lmbd, F.lit(1.0 - alpha))
    return F.when(norm == 0, 1.0).otherwise(norm)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clean_score(x: Column) -> Column:
    """NaN and missing scores count as 0."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0),
                       lambda total, x: total + x)


def seeded_number(seed: int, *parts: Column) -> Column:
    """A repeatable number in [0, 2^60) from the seed and the row's values."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def seeded_residue(seed: int, *parts: Column) -> Column:
    """A repeatable number in [1, PRIME)."""
    return seeded_number(seed, *parts) % (PRIME - 1) + 1
