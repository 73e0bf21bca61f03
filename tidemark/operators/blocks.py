"""Distributed row positions, prefix sums and windows over bounded blocks.

A plain ``Window.partitionBy(symbol)`` puts the whole history of a symbol into one task. Everything
here splits a key's rows into blocks of bounded size first:

* ``bucket_offsets`` / ``with_position``: prefix sums from per-bucket totals, so only one small row
  per (key, bucket) meets in a window by key;
* ``with_halo``: row blocks that carry a copy of the rows a look-back or look-ahead needs, so any
  window function with a bounded reach gives the same answer as over the whole key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK_ROWS = 1024
MOST_ROWS = BLOCK_ROWS + 768 + 288  # with the longest look-back and look-ahead


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a (session-UTC or zone-less) timestamp."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    c = F.col(us) if isinstance(us, str) else us
    return F.timestamp_micros(c).cast("timestamp_ntz")


def floor_div(x: Column, n: int) -> Column:
    """Integer floor division, right for negative numbers too."""
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("long")


def bucket_offsets(df: DataFrame, keys: Sequence[str], bucket: str, **sums: Column) -> DataFrame:
    """One row per (keys, bucket) with each sum taken over all *earlier* buckets of the key."""
    totals = df.groupBy(*keys, bucket).agg(*[e.alias(n) for n, e in sums.items()])
    w = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    return totals.select(*keys, bucket, *[F.coalesce(F.sum(n).over(w), zero).alias(n) for n in sums])


def with_position(
    df: DataFrame, keys: Sequence[str], order: str, block_us: int, out: str = "pos", ties: Sequence[str] = ()
) -> DataFrame:
    """Add the 0-based row position inside each key, ordered by the long column ``order``.

    Rows are numbered inside time blocks of ``block_us`` and shifted by the number of rows in the
    earlier blocks, so no task sees more than one block of a key.
    """
    d = df.withColumn("_tb", floor_div(F.col(order), block_us))
    off = bucket_offsets(d.select(*keys, "_tb"), keys, "_tb", _off=F.count(F.lit(1)))
    w = W.partitionBy(*keys, "_tb").orderBy(order, *ties)
    return (
        d.withColumn("_rn", F.row_number().over(w) - 1)
        .join(off, [*keys, "_tb"])
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_tb", "_rn", "_off")
    )


def with_halo(
    df: DataFrame, pos: str = "pos", before: int = 0, after: int = 0, size: int = BLOCK_ROWS
) -> DataFrame:
    """Repeat each row for every block of ``size`` positions whose windows can reach it.

    Adds ``blk`` (block number) and ``own`` (true on the one copy that belongs to the block).
    """
    p = F.col(pos)
    lo = F.greatest(floor_div(p - F.lit(after), size), F.lit(0).cast("long"))
    hi = floor_div(p + F.lit(before), size)
    return df.withColumn("blk", F.explode(F.sequence(lo, hi))).withColumn(
        "own", floor_div(p, size) == F.col("blk")
    )


def with_time_halo(df: DataFrame, order: str, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Same as ``with_halo`` for windows measured in the long column ``order`` itself."""
    t = F.col(order)
    return df.withColumn(
        "blk", F.explode(F.sequence(floor_div(t - F.lit(after), width), floor_div(t + F.lit(before), width)))
    ).withColumn("own", floor_div(t, width) == F.col("blk"))


def block_window(keys: Sequence[str], order: str, *ties: str):
    return W.partitionBy(*keys, "blk").orderBy(order, *ties)


def full(x: Column, agg, w, n: int) -> Column:
    """``agg(x)`` over the last ``n`` rows, NULL unless all ``n`` values are there."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(f) == n, agg(x).over(f))


def ema(x: Column, alpha: float, w, seed: int = 0) -> Column:
    """Recursive mean ``y = (1-a)*y_prev + a*x`` from the row at position ``seed`` on.

    Written as a running sum of ``x_j * (1-a)^-j`` times ``(1-a)^i``, with the columns ``idx`` (row
    index inside the block), ``start`` (first position held by the block) and ``pos``. ``idx`` must
    stay below ``700 / -ln(1-a)`` to keep the powers finite. In a block that does not hold the seed
    the start value has faded by ``(1-a)^halo`` before the first owned row, far below one unit in
    the last place for the halo used here.
    """
    if MOST_ROWS * -math.log(1.0 - alpha) > 700:
        raise ValueError("alpha is too large for the rows of a block: the powers would overflow")
    d = F.lit(1.0 - alpha)
    idx, pos = F.col("idx"), F.col("pos")
    share = F.when(pos == F.greatest(F.col("start"), F.lit(seed)), F.lit(1.0)).otherwise(F.lit(alpha))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    return F.pow(d, idx) * F.sum(F.when(pos >= seed, x * share * F.pow(d, -idx))).over(run)
