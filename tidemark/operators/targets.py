"""Return targets, news labels and target scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.asof import asof
from tidemark.operators.blocks import BLOCK_ROWS, block_window, with_time_halo
from tidemark.operators.features import EMA_HALO, FEATURES, KEYS, add_features, base_return, blocked, log_ratio, owned
from tidemark.tables import HOUR

# Short horizons in bars, and the long one.
HORIZONS = list(range(1, 13))
LONG_HORIZONS = [288]
NEUTRAL = 0.0015


def target_cols(w, horizons: Sequence[int], interval_us: int) -> dict[str, Column]:
    """ln(close at exactly t + h bars / close); NULL where no bar has that very timestamp."""
    c = F.col("close")
    return {
        f"r_{h}": log_ratio(F.first("close").over(w.rangeBetween(h * interval_us, h * interval_us)), c)
        for h in horizons
    }


def targets(
    bars: DataFrame, horizons: Sequence[int] = tuple(HORIZONS + LONG_HORIZONS), interval_us: int = HOUR
) -> DataFrame:
    """Exact-timestamp targets: one shuffle on (symbol, time block), one sort for all horizons."""
    reach = max(horizons) * interval_us
    d = with_time_halo(bars, "t", max(BLOCK_ROWS * interval_us, reach), after=reach)
    d = d.withColumns(target_cols(block_window(KEYS, "t"), horizons, interval_us))
    return owned(d, [*bars.columns, *[f"r_{h}" for h in horizons]])


def dataset(
    bars: DataFrame,
    horizons: Sequence[int] = tuple(HORIZONS + LONG_HORIZONS),
    base: str | None = None,
    interval_us: int = HOUR,
) -> DataFrame:
    """Features and targets side by side, from the same blocks and the same sort.

    Candle times are unique multiples of the interval, so the bar ``h`` intervals ahead is at most
    ``h`` rows away and the forward halo can be counted in rows.
    """
    d = blocked(bars, EMA_HALO, max(horizons), interval_us)
    d = add_features(d).withColumns(target_cols(block_window(KEYS, "t"), horizons, interval_us))
    names = [f"r_{h}" for h in horizons]
    out = owned(d, [*bars.columns, "pos", "ret", *FEATURES, *names])
    if base is not None:
        ret = base_return(bars, base, interval_us)
        own = F.when(F.col("symbol") != base, F.col("base_ret"))
        out = out.join(ret, "t", "left").withColumn("base_ret", own)
    return out


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Model inputs: everything except keys, raw candles, helpers and targets."""
    raw = {"symbol", "t", "ts", "open", "high", "low", "close", "volume", "pos", "ret"}
    goals = {f"r_{h}" for h in [*HORIZONS, *LONG_HORIZONS]}
    return [c for c in columns if c not in raw and c not in goals]


def step_ahead(bars: DataFrame, steps: int, interval_us: int = HOUR) -> DataFrame:
    """Bars with the close ``steps`` *rows* later (not an exact time), NULL past the end."""
    d = blocked(bars, 0, steps, interval_us)
    d = d.withColumn("exit_close", F.lead("close", steps).over(block_window(KEYS, "t")))
    return owned(d, ["symbol", "t", F.col("close").alias("entry_close"), "exit_close"])


def label_news(
    news: DataFrame, bars: DataFrame, steps: int = 12, threshold: float = NEUTRAL, interval_us: int = HOUR
) -> DataFrame:
    """News with the return from the first bar at/after publication to ``steps`` rows later.

    Items without such an exit bar are dropped. ``news`` carries ``symbol`` and ``t``.
    """
    hit = asof(
        news, step_ahead(bars, steps, interval_us), KEYS, ["entry_close", "exit_close"], forward=True, snap_us=interval_us
    )
    r = F.col("log_return")
    label = F.when(r > threshold, "positive").when(r < -threshold, "negative").otherwise("neutral")
    return (
        hit.filter("exit_close is not null")
        .withColumn("log_return", log_ratio(F.col("exit_close"), F.col("entry_close")))
        .withColumn("label", label)
        .drop("entry_close", "exit_close", "hit_t")
    )


def vol_scaled(target: Column, sigma: Column) -> Column:
    return target / F.nullif(sigma, F.lit(0.0))


def vol_unscaled(prediction: Column, sigma: Column) -> Column:
    return prediction * F.nullif(sigma, F.lit(0.0))
