"""Slow-moving rate series on candles: trailing z-score, as-of attachment, settlement panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.asof import asof
from tidemark.operators.blocks import block_window, with_time_halo
from tidemark.tables import DAY

KEYS = ["symbol"]
Z_WINDOW = 30 * DAY
Z_MIN = 30


def funding_z(rates: DataFrame, window_us: int = Z_WINDOW, min_rows: int = Z_MIN) -> DataFrame:
    """Rates with ``f_z`` over the last ``window_us``: the row exactly that old no longer counts."""
    w = block_window(KEYS, "t").rangeBetween(-(window_us - 1), 0)
    d = with_time_halo(rates, "t", 4 * window_us, before=window_us)
    sd = F.nullif(F.stddev_samp("rate").over(w), F.lit(0.0))
    z = F.when(F.count("rate").over(w) >= min_rows, (F.col("rate") - F.avg("rate").over(w)) / sd)
    return d.withColumn("f_z", z).filter("own").drop("blk", "own")


def attach_funding(bars: DataFrame, rates: DataFrame, window_us: int = Z_WINDOW, min_rows: int = Z_MIN) -> DataFrame:
    """Newest rate and z-score at or before every bar; NULL before the first settlement."""
    z = funding_z(rates, window_us, min_rows).select("symbol", "t", F.col("rate").alias("f_rate"), "f_z")
    return asof(bars, z, KEYS, ["f_rate", "f_z"], hit="funding_t").withColumn("f_absz", F.abs("f_z"))


def settlement_panel(rates_z: DataFrame, targets: DataFrame, cols: list[str], tolerance_us: int) -> DataFrame:
    """One forward row per settlement: the first bar at or after it, within the tolerance."""
    return asof(rates_z, targets, KEYS, cols, forward=True, tolerance_us=tolerance_us, hit="bar_t")
