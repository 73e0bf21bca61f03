"""News on a candle grid: decayed sentiment, event flags, latest category.

News items are summed into the grid's time slots before anything meets in a window, so a burst that
holds a third of all items costs one row per slot, not one pair per (item, candle).

A slot k holds the items with (k-1)*step < t <= k*step. For a grid time T = K*step the window
[T - m*step, T] is exactly the slots K-m+1 .. K plus the items *at* T - m*step, which are kept apart
as the slot's "edge" sums.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import EVENT_TYPES
from tidemark.operators.blocks import block_window, floor_div, with_time_halo
from tidemark.tables import MINUTE

# Half-life, window lengths in half-lives and minutes.
HALF_LIFE_MIN = 90.0
HORIZON_HALF_LIVES = 16
RECENT_MIN = 60
DAY_MIN = 1440

DECAY_FEATURES = ["sentiment_weighted", "news_intensity", "max_magnitude_60m", "sentiment_dispersion"]


def _steps(minutes: float, step_us: int) -> int:
    us = round(minutes * 60) * 1_000_000
    if us % step_us:
        raise ValueError("the window must be a whole number of grid steps")
    return us // step_us


def slot_of(t: Column, step_us: int) -> Column:
    return floor_div(t + F.lit(step_us - 1), step_us)


def on_grid(t: Column, step_us: int) -> Column:
    """Grid time as a slot number; a time between two slots is an error, not a rounded answer."""
    bad = F.raise_error(F.lit("grid times must be multiples of the step")).cast("long")
    return F.when(F.pmod(t, F.lit(step_us)) == 0, floor_div(t, step_us)).otherwise(bad)


def slots(items: DataFrame, grid: DataFrame, keys: Sequence[str], step_us: int, sums: Mapping[str, tuple]) -> DataFrame:
    """One row per (keys, slot) that holds items or a grid time.

    ``sums`` maps a name to (aggregate, value); ``name`` is taken over the slot's items and
    ``name_e`` over those exactly on the slot's time. ``gts`` is set on grid rows.
    """
    edge = F.pmod(F.col("t"), F.lit(step_us)) == 0
    vals = {n: v for n, (_, v) in sums.items()}
    it = items.select(
        *keys, slot_of(F.col("t"), step_us).alias("k"), F.lit(None).cast("long").alias("gts"),
        *[v.alias(n) for n, v in vals.items()], *[F.when(edge, v).alias(f"{n}_e") for n, v in vals.items()],
    )
    gr = grid.select(*keys, on_grid(F.col("t"), step_us).alias("k"), F.col("t").alias("gts"))
    agg = [F.max("gts").alias("gts")]
    for n, (fn, _) in sums.items():
        agg += [fn(n).alias(n), fn(f"{n}_e").alias(f"{n}_e")]
    return it.unionByName(gr, allowMissingColumns=True).groupBy(*keys, "k").agg(*agg)


def _window(name: str, fn, w, m: int) -> Column:
    """Aggregate of the closed window of m steps: whole slots and the far edge."""
    inner = fn(name).over(w.rangeBetween(-(m - 1), 0))
    edge = fn(f"{name}_e").over(w.rangeBetween(-m, -m))
    if fn is F.max:
        return F.greatest(inner, edge)
    return F.coalesce(inner, F.lit(0)) + F.coalesce(edge, F.lit(0))


def decay_features(
    news: DataFrame, grid: DataFrame, keys: Sequence[str], step_us: int, events: Mapping[str, Column],
    half_life_min: float = HALF_LIFE_MIN,
) -> DataFrame:
    """Decay-weighted sentiment, intensity and dispersion, 60-minute magnitude and event flags.

    ``news`` has keys, ``t`` and sentiment_pos/neg/neu; ``events`` are boolean columns of it. One row
    per grid row; without an item in the decay window every feature is 0 or false.
    """
    m = _steps(half_life_min * HORIZON_HALF_LIVES, step_us)
    r = _steps(RECENT_MIN, step_us)
    lam = math.log(2) / (half_life_min * MINUTE)
    # Weights are kept relative to the slot end, then to the block start: powers stay finite.
    width = max(min(1024, int(500 / (lam * step_us)) - max(m, r)), 1)
    s = F.col("sentiment_pos") - F.col("sentiment_neg")
    age = slot_of(F.col("t"), step_us) * F.lit(step_us) - F.col("t")
    wt = F.exp(-F.lit(lam) * age)
    sums = {
        "n": (F.sum, F.lit(1)),
        "w0": (F.sum, wt),
        "w1": (F.sum, wt * s),
        "w2": (F.sum, wt * s * s),
        "mag": (F.max, 1 - F.col("sentiment_neu")),
        **{f"ev_{e}": (F.max, c.cast("int")) for e, c in events.items()},
    }
    d = slots(news, grid, keys, step_us, sums)
    d = with_time_halo(d, "k", width, before=max(m, r))
    up = F.exp(F.lit(lam * step_us) * (F.col("k") - F.col("blk") * width))
    d = d.withColumns({c: F.col(c) * up for x in ("w0", "w1", "w2") for c in (x, f"{x}_e")})
    w = block_window(keys, "k")
    parts = {x: _window(x, F.sum, w, m) / up for x in ("w0", "w1", "w2")}
    parts["n"] = _window("n", F.sum, w, m)
    parts["mag"] = _window("mag", F.max, w, r)
    parts |= {f"ev_{e}": _window(f"ev_{e}", F.max, w, r) for e in events}
    d = d.withColumns({f"o_{k}": v for k, v in parts.items()}).filter("own and gts is not null")
    any_ = F.col("o_n") > 0

    def num(c):
        return F.when(any_, F.coalesce(c, F.lit(0.0))).otherwise(0.0)

    w0 = F.nullif(F.col("o_w0"), F.lit(0.0))
    mean = F.col("o_w1") / w0
    var = F.greatest(F.col("o_w2") / w0 - mean * mean, F.lit(0.0))
    return d.select(
        *keys,
        F.col("gts").alias("t"),
        num(F.col("o_w1")).alias("sentiment_weighted"),
        num(F.col("o_w0")).alias("news_intensity"),
        num(F.col("o_mag")).alias("max_magnitude_60m"),
        num(F.sqrt(var)).alias("sentiment_dispersion"),
        *[(any_ & F.coalesce(F.col(f"o_ev_{e}") == 1, F.lit(False))).alias(f"event_{e}_60m") for e in events],
    )


def event_flags(
    news: DataFrame, grid: DataFrame, keys: Sequence[str], step_us: int, minutes: int, suffix: str, kinds=tuple(EVENT_TYPES)
) -> DataFrame:
    """Whether an item of each kind was published in the closed trailing window."""
    m = _steps(minutes, step_us)
    sums = {f"ev_{k}": (F.max, (F.col("llm_event_type") == k).cast("int")) for k in kinds}
    d = with_time_halo(slots(news, grid, keys, step_us, sums), "k", 1024, before=m)
    w = block_window(keys, "k")
    d = d.withColumns({f"o_{k}": _window(f"ev_{k}", F.max, w, m) for k in kinds}).filter("own and gts is not null")
    return d.select(
        *keys,
        F.col("gts").alias("t"),
        *[F.coalesce(F.col(f"o_{k}") == 1, F.lit(False)).alias(f"event_llm_{k}_{suffix}") for k in kinds],
    )


def recent_category(news: DataFrame, grid: DataFrame, keys: Sequence[str], step_us: int, minutes: int) -> DataFrame:
    """Category of the newest classified item in the closed trailing window, 'none' without one.

    Items at the same time are ordered by url, so the answer does not depend on row order.
    """
    m = _steps(minutes, step_us)
    newest = F.struct(F.col("t"), F.col("url"), F.col("llm_event_type").alias("cat"))
    sums = {"last": (F.max, newest)}
    d = slots(news.filter("llm_event_type is not null"), grid, keys, step_us, sums)
    d = with_time_halo(d, "k", 1024, before=m)
    w = block_window(keys, "k")
    d = d.withColumn("hit", _window("last", F.max, w, m)).filter("own and gts is not null")
    return d.select(*keys, F.col("gts").alias("t"), F.coalesce("hit.cat", F.lit("none")).alias("recent_category"))
