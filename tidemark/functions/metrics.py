"""Forecast metrics as aggregate column expressions; rows with a NULL side do not count."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def both(a: Column, p: Column) -> Column:
    return a.isNotNull() & p.isNotNull()


def mae(a: Column, p: Column) -> Column:
    return F.avg(F.abs(a - p))


def hit(a: Column, p: Column) -> Column:
    """1 when the signs agree (0 with 0 included), NULL when a side is missing."""
    return F.when(both(a, p), (F.signum(a) == F.signum(p)).cast("int"))


def directional_accuracy(a: Column, p: Column) -> Column:
    return F.avg(hit(a, p))


def pinball(a: Column, p: Column, q: float) -> Column:
    d = a - p
    return F.avg(F.greatest(F.lit(q) * d, F.lit(q - 1) * d))


def coverage(a: Column, p: Column) -> Column:
    return F.avg((a <= p).cast("int"))


def n_pairs(a: Column, p: Column) -> Column:
    return F.count(F.when(both(a, p), 1))


def naive_mae(y: Column) -> Column:
    return F.avg(F.abs(y))
