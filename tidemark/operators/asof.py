"""As-of joins as a sweep over the union of both sides, in time buckets.

The newest right row of every bucket is carried into the later buckets of its key, so a bucket can
be swept on its own. No theta join, and no task holds more than one (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.blocks import floor_div
from tidemark.tables import DAY


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    *,
    forward: bool = False,
    tolerance_us: int | None = None,
    width_us: int = 7 * DAY,
    snap_us: int | None = None,
    hit: str = "hit_t",
) -> DataFrame:
    """Left rows with ``cols`` of the nearest right row at or before (``forward``: at or after) ``t``.

    Both sides carry the long time column ``t``; right is unique per (keys, t). ``hit`` receives the
    right row's time. With ``snap_us`` the right side is known to lie on multiples of that step, and
    the left side is first reduced to one row per (keys, step): any number of left rows at one time
    then costs one row in the sweep and an equi-join back, which a skewed key cannot hurt.
    """
    if snap_us:
        t = F.col("t")
        up = floor_div(t + F.lit(snap_us - 1), snap_us) if forward else floor_div(t, snap_us)
        tagged = left.withColumn("_snap", up * F.lit(snap_us))
        points = tagged.select(*keys, F.col("_snap").alias("t")).distinct()
        found = _sweep(points, right, keys, cols, forward, width_us, hit)
        out = tagged.join(found.withColumnRenamed("t", "_snap"), [*keys, "_snap"], "left").drop("_snap")
        out = out.select(*left.columns, hit, *cols)
    else:
        out = _sweep(left, right, keys, cols, forward, width_us, hit)
    if tolerance_us is not None:
        near = F.abs(F.col(hit) - F.col("t")) <= tolerance_us
        out = out.withColumns({c: F.when(near, F.col(c)) for c in [hit, *cols]})
    return out


def _sweep(left, right, keys, cols, forward, width_us, hit) -> DataFrame:
    order = -F.col("t") if forward else F.col("t")
    none_row = F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType)
    found = F.struct(F.col("t").alias(hit), *cols)

    r = right.select(*keys, order.alias("_o"), found.alias("_hit")).withColumn("_b", floor_div(F.col("_o"), width_us))
    lft = left.select(*keys, order.alias("_o"), F.struct(*left.columns).alias("_row")).withColumn(
        "_b", floor_div(F.col("_o"), width_us)
    )
    hit_type = r.schema["_hit"].dataType

    # Newest right row of each bucket, handed on to every later bucket that has left rows.
    tails = r.groupBy(*keys, "_b").agg(F.max_by("_hit", "_o").alias("_tail"))
    wanted = lft.select(*keys, "_b").distinct().withColumn("_tail", F.lit(None).cast(hit_type))
    per_bucket = tails.unionByName(wanted).groupBy(*keys, "_b").agg(F.max_by("_tail", F.col("_tail").isNotNull()).alias("_tail"))
    w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "_b", F.last("_tail", ignorenulls=True).over(w).alias("_hit")).filter(
        "_hit is not null"
    )

    low = F.lit(-(2**63) + 1).cast("long")
    rows = (
        carry.select(*keys, "_b", low.alias("_o"), F.lit(0).alias("_side"), "_hit", none_row.alias("_row"))
        .unionByName(r.select(*keys, "_b", "_o", F.lit(1).alias("_side"), "_hit", none_row.alias("_row")))
        .unionByName(
            lft.select(*keys, "_b", "_o", F.lit(2).alias("_side"), F.lit(None).cast(hit_type).alias("_hit"), "_row")
        )
    )
    w = W.partitionBy(*keys, "_b").orderBy("_o", "_side").rowsBetween(W.unboundedPreceding, 0)
    swept = rows.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).filter("_side = 2")
    return swept.select("_row.*", "_hit.*")
