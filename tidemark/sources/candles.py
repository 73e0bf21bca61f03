"""Candle scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def load_candles(candles: DataFrame, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One symbol's candles, both bounds inclusive, a missing bound is open, oldest first.

    The predicates stay plain comparisons so that a parquet or JDBC scan can take them over.
    """
    d = candles.filter(F.col("symbol") == symbol)
    if start is not None:
        d = d.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        d = d.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return d.orderBy("ts")


def list_symbols(candles: DataFrame) -> DataFrame:
    return candles.select("symbol").distinct().orderBy("symbol")
