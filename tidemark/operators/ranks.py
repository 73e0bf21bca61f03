"""Exact order statistics without sorting a key's rows in one task.

Values are counted first (a hot value becomes one row), then the distinct values of a key are cut
into ranges at sketched quantiles and numbered range by range. The cut points only balance the
work: any cut gives the same exact ranks. They are checkpointed so that a retried task sees the
same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.blocks import bucket_offsets
from tidemark.session import settle

RANGE_VALUES = 1 << 18  # distinct values of a key that one task numbers
MIN_RANGES = 8


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """(keys, value, n, below): rows with this value, and rows of the key with a smaller one.

    The number of ranges follows the distinct values of the largest key.
    """
    if not keys:
        raise ValueError("ordered_counts needs at least one key column")
    counts = settle(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    if ranges is None:
        most = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        ranges = max(MIN_RANGES, -(-most // RANGE_VALUES))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = settle(counts.groupBy(*keys).agg(F.percentile_approx(value, probs, max(1000, 10 * ranges)).alias("_cuts")))
    rng = F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_rng")
    d = counts.join(cuts, [*keys]).select(*keys, value, "n", rng)
    off = bucket_offsets(d, [*keys], "_rng", _off=F.sum("n"))
    w = W.partitionBy(*keys, "_rng").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return d.join(off, [*keys, "_rng"]).select(
        *keys, value, "n", (F.col("_off") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("below")
    )


def average_rank() -> Column:
    """1-based rank with ties averaged, on a row of ``ordered_counts``."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """One row per key: count ``n_rows`` and the linearly interpolated quantiles ``q1``, ``q2``, ..."""
    c = ordered_counts(df, keys, value)
    total = settle(df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")))
    d = c.join(total, [*keys])
    aggs = []
    for i, p in enumerate(probs, 1):
        at = (F.col("n_rows") - 1) * F.lit(float(p))
        for name, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("below") <= idx) & (idx < F.col("below") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}{i}"))
    g = d.groupBy(*keys, "n_rows").agg(*aggs)
    cols = []
    for i, p in enumerate(probs, 1):
        at = (F.col("n_rows") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"{out}{i}"))
    return g.select(*keys, "n_rows", *cols)


ACCURACY = 2000  # of the sketch that brackets a quantile
MARGIN = 2.0  # half the bracket's width, in units of the sketch's error


def bracketed_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """``exact_quantiles`` for large groups and few levels, without a copy of the values on disk.

    A mergeable sketch gives each level a bracket. A second reading counts what lies below it and keeps the counts of
    the values inside, a small share of the group (equal values are one row), in which the level is selected. A group
    whose bracket misses its level, which the sketch's error bound should rule out, goes the way of ``exact_quantiles``.
    """
    keys = list(keys)
    d = df.filter(F.col(value).isNotNull()).select(*keys, value)
    m = MARGIN / ACCURACY
    ends = [x for p in probs for x in (max(0.0, p - m), min(1.0, p + m))]
    b = settle(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.percentile_approx(value, ends, ACCURACY).alias("_b")))
    v = F.col(value)
    tags = [
        F.when(v <= F.get("_b", F.lit(2 * i + 1)), F.struct(F.lit(i).alias("i"), F.when(v >= F.get("_b", F.lit(2 * i)), v).alias("v"))) for i in range(len(probs))
    ]
    c = d.join(b, keys).select(*keys, "n_rows", F.explode(F.array_compact(F.array(*tags))).alias("_t"))
    c = settle(c.groupBy(*keys, "n_rows", "_t").agg(F.count(F.lit(1)).alias("n")).select(*keys, "n_rows", "_t.*", "n"))
    upto = F.sum("n").over(W.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()))
    c = c.withColumn("_upto", upto)
    aggs, cols, held = [], [], F.lit(True)
    for i, p in enumerate(probs):
        at = (F.col("n_rows") - 1) * F.lit(float(p))
        mine = F.col("i") == i
        inside = mine & F.col("v").isNotNull()
        for part, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.min(F.when(inside & (F.col("_upto") > k), F.col("v"))).alias(f"_{part}{i}"))
        aggs.append((F.coalesce(F.max(F.when(mine & F.col("v").isNull(), F.col("n"))), F.lit(0)) <= F.max(F.floor(at))).alias(f"_ok{i}"))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        held = held & F.col(f"_ok{i}") & hi.isNotNull()
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"{out}{i + 1}"))
    g = settle(c.groupBy(*keys, "n_rows").agg(*aggs).select(*keys, "n_rows", *cols, held.alias("_held")))
    done = g.filter("_held").drop("_held")
    missed = g.filter("not _held").select(*keys)
    if missed.isEmpty():
        return done
    return done.unionByName(exact_quantiles(d.join(missed, keys, "left_semi"), keys, value, probs, out))


def right_closed(x: Column, edges: Sequence[Column]) -> Column:
    """Bucket 0.. of (e0, e1], (e1, e2], ... after equal edges are merged; e0 itself is in bucket 0."""
    inner = F.array_distinct(F.array(*edges))
    below = F.size(F.filter(inner, lambda e: e < x))
    return F.when(x.isNotNull(), F.greatest(below - 1, F.lit(0)))


def left_closed(x: Column, edges: Sequence[Column]) -> Column:
    """Bucket 0.. by inner edges, a value on an edge belongs to the upper bucket."""
    return F.when(x.isNotNull(), sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0)))
