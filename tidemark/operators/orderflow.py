"""Trades to order-flow bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import ranks as R
from tidemark.operators.blocks import from_micros
from tidemark.session import settle
from tidemark.tables import DAY, HOUR

KEYS = ["symbol"]
LARGE = 0.90


def flow_aggs() -> list[Column]:
    buy, q = ~F.col("is_buyer_maker"), F.col("qty")
    large = q >= F.col("large_qty")

    def vol(c):
        return F.sum(F.when(c, q).otherwise(0.0))

    n_buy = F.count(F.when(buy, 1))
    return [
        F.count(F.lit(1)).alias("n_trades"), F.sum("qty").alias("total_vol"), vol(buy).alias("buy_vol"),
        vol(~buy).alias("sell_vol"), n_buy.alias("buy_cnt"), (F.count(F.lit(1)) - n_buy).alias("sell_cnt"),
        vol(buy & large).alias("large_buy_vol"), vol(~buy & large).alias("large_sell_vol"),
    ]


def day_of(t: Column) -> Column:
    return t - F.pmod(t, F.lit(DAY))


def large_thresholds(trades: DataFrame, q: float = LARGE) -> DataFrame:
    """Exact q-quantile of the trade size per symbol and day: trades are read twice and written never."""
    d = trades.withColumn("day", day_of(F.col("t")))
    return R.bracketed_quantiles(d, ["symbol", "day"], "qty", [q]).select("symbol", "day", F.col("q1").alias("large_qty"))


def ofi_bars(trades: DataFrame, interval_us: int = HOUR) -> DataFrame:
    """Counts and buy/sell/large volumes per bar; large = at or above the day's own 90 % size."""
    d = trades.withColumn("day", day_of(F.col("t"))).join(settle(large_thresholds(trades)), ["symbol", "day"])
    slot = F.col("t") - F.pmod(F.col("t"), F.lit(interval_us))
    return d.groupBy("symbol", slot.alias("t")).agg(*flow_aggs()).withColumn("ts", from_micros("t"))
