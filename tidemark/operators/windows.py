"""Order statistics of many overlapping time windows, without a copy of a row per window.

A key's rows are cut twice: by position into slices, at every window's ends, and by value into ranges. Rows are counted
once per (slice, range, value). Running sums over the slices then give any window's rows in any range as a difference of
two numbers, so a window knows in which range its quantile lies, and only that range's values are looked at for it. With
as many ranges as windows, that is in all a fixed number of looks at each row, however many windows there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.ranks import MIN_RANGES, RANGE_VALUES
from tidemark.session import settle

MOST_RANGES = 4096


@dataclass
class Grid:
    keys: list[str]
    name: str  # the window's number within its key
    counts: DataFrame  # keys, _s, _rng, _v and the sums: one row per slice and value
    upto: DataFrame  # keys, _rng, _s and the sums of all earlier slices, for every slice and range
    windows: DataFrame  # keys, name, _lo, _hi: the slices [_lo, _hi) of a window
    cuts: DataFrame  # keys, _cuts: the upper ends of the ranges
    sums: list[str]


def grid(
    rows: DataFrame, windows: DataFrame, keys: Sequence[str], value: str, at: str, lo: str, hi: str, name: str = "fold",
    sums: dict[str, Column] | None = None,
) -> Grid:
    """Counts of ``value`` for windows lo <= at < hi; ``sums`` are further aggregates (counts, sums) to carry.

    Rows without a value and rows in no window play no part. Any cuts give the same results: they only share the work.
    """
    keys = list(keys)
    aggs = {"n": F.count(F.lit(1)), **(sums or {})}
    w = settle(windows.select(*keys, name, F.col(lo).cast("long").alias("_from"), F.col(hi).cast("long").alias("_to")).filter("_from < _to"))
    ends = w.select(*keys, F.explode(F.array("_from", "_to")).alias("_e")).groupBy(*keys).agg(F.sort_array(F.collect_set("_e")).alias("_b"), F.count(F.lit(1)).alias("_w"))
    ends = settle(ends)
    d = rows.filter(F.col(value).isNotNull()).join(ends.select(*keys, "_b"), keys)
    d = d.withColumn("_s", F.size(F.filter("_b", lambda e: e <= F.col(at)))).filter((F.col("_s") > 0) & (F.col("_s") < F.size("_b")))
    c = settle(d.groupBy(*keys, "_s", F.col(value).alias("_v")).agg(*[a.alias(k) for k, a in aggs.items()]))
    most = c.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    folds = ends.agg(F.max("_w")).first()[0] or 0
    ranges = min(MOST_RANGES, max(MIN_RANGES, -(-most // RANGE_VALUES), folds))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = settle(c.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", probs, max(1000, 10 * ranges))).alias("_cuts")))
    c = settle(c.join(cuts, keys).withColumn("_rng", _range(F.col("_v"))).drop("_cuts"))
    cells = ends.join(cuts, keys).select(*keys, F.explode(F.sequence(F.lit(1), F.size("_b"))).alias("_s"), "_cuts")
    cells = cells.select(*keys, "_s", F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_rng"))
    per = c.groupBy(*keys, "_rng", "_s").agg(*[F.sum(k).alias(k) for k in aggs])
    before = W.partitionBy(*keys, "_rng").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    upto = cells.join(per, [*keys, "_rng", "_s"], "left").select(*keys, "_rng", "_s", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in aggs])
    placed = w.join(ends.select(*keys, "_b"), keys).select(*keys, name, F.array_position("_b", F.col("_from")).cast("int").alias("_lo"), F.array_position("_b", F.col("_to")).cast("int").alias("_hi"))
    return Grid(keys, name, c, settle(upto), settle(placed), cuts, list(aggs))


def _range(v: Column) -> Column:
    return F.size(F.filter("_cuts", lambda c: c < v))


def by_range(g: Grid) -> DataFrame:
    """(keys, name, _lo, _hi, _rng, sums, sums below): every window's rows per range, and in the ranges before it."""
    hi = g.windows.join(g.upto.withColumnRenamed("_s", "_hi"), [*g.keys, "_hi"])
    lo = g.upto.select(*g.keys, "_rng", F.col("_s").alias("_lo"), *[F.col(k).alias(f"_{k}0") for k in g.sums])
    d = hi.join(lo, [*g.keys, "_rng", "_lo"]).select(*g.keys, g.name, "_lo", "_hi", "_rng", *[(F.col(k) - F.col(f"_{k}0")).alias(k) for k in g.sums])
    before = W.partitionBy(*g.keys, g.name).orderBy("_rng").rowsBetween(W.unboundedPreceding, -1)
    return d.withColumns({f"below_{k}": F.coalesce(F.sum(k).over(before), F.lit(0)) for k in g.sums})


def _inside(g: Grid, wanted: DataFrame) -> DataFrame:
    """The counted values of the slices [_lo, _hi) and the range that each row of ``wanted`` names."""
    c = g.counts.select(*g.keys, "_rng", "_s", "_v", *[F.col(k).alias(f"in_{k}") for k in g.sums])
    return wanted.join(c, [*g.keys, "_rng"]).filter((F.col("_s") >= F.col("_lo")) & (F.col("_s") < F.col("_hi")))


def quantiles(g: Grid, probs: Sequence[float], out: str = "q") -> DataFrame:
    """(keys, name, n_rows, q1, q2, ...): exact, linearly interpolated quantiles of every window that has rows."""
    spread = settle(by_range(g))
    total = spread.groupBy(*g.keys, g.name).agg(F.sum("n").alias("n_rows")).filter("n_rows > 0")
    at = [(F.col("n_rows") - 1) * F.lit(float(p)) for p in probs]
    want = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    places = total.select(*g.keys, g.name, F.explode(want).alias("_k"))
    hit = spread.filter("n > 0").join(places, [*g.keys, g.name]).filter((F.col("below_n") <= F.col("_k")) & (F.col("_k") < F.col("below_n") + F.col("n")))
    hit = hit.select(*g.keys, g.name, "_lo", "_hi", "_rng", "_k", (F.col("_k") - F.col("below_n")).alias("_at"))
    group = [*g.keys, g.name, "_k", "_at"]
    near = _inside(g, hit).groupBy(*group, "_v").agg(F.sum("in_n").alias("m"))
    upto = F.sum("m").over(W.partitionBy(*group).orderBy("_v"))
    found = near.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_at")).groupBy(*g.keys, g.name, "_k").agg(F.min("_v").alias("_v"))
    m = found.groupBy(*g.keys, g.name).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))
    value = lambda k: F.element_at("_m", k.cast("long"))
    cols = [(value(F.floor(a)) + (value(F.ceil(a)) - value(F.floor(a))) * (a - F.floor(a))).alias(f"{out}{i}") for i, a in enumerate(at, 1)]
    return total.join(m, [*g.keys, g.name]).select(*g.keys, g.name, "n_rows", *cols)


def below(g: Grid, edges: DataFrame, edge: str = "edge") -> DataFrame:
    """(keys, name, edge, sums): each window's rows with a value under ``edge``; one row per row of ``edges``."""
    e = edges.select(*g.keys, g.name, edge).distinct().join(g.cuts, g.keys).withColumn("_rng", _range(F.col(edge))).drop("_cuts")
    e = settle(e.join(by_range(g), [*g.keys, g.name, "_rng"]))
    part = _inside(g, e).filter(F.col("_v") < F.col(edge)).groupBy(*g.keys, g.name, edge).agg(*[F.sum(f"in_{k}").alias(f"in_{k}") for k in g.sums])
    return e.join(part, [*g.keys, g.name, edge], "left").select(*g.keys, g.name, edge, *[(F.col(f"below_{k}") + F.coalesce(f"in_{k}", F.lit(0))).alias(k) for k in g.sums])
