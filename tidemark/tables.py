"""Views of the given tables as bars, trades, news, funding and registry inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.blocks import from_micros, micros
from tidemark.session import prepare, settle

HOUR = 3_600_000_000
DAY = 24 * HOUR
MINUTE = 60_000_000

# The event types, sorted; position = asset number.
SYMBOLS = ["click", "error", "purchase", "signup", "view"]
BASE_SYMBOL = "click"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def ohlcv(trades: DataFrame, interval_us: int = HOUR) -> DataFrame:
    """Trades (symbol, t, seq, price, qty) to one candle per (symbol, interval)."""
    slot = F.col("t") - F.pmod(F.col("t"), F.lit(interval_us))
    # (t, seq) as one fixed-width number: a struct in the buffer would force a sort of all trades.
    order = F.col("t").cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("seq").cast("decimal(19,0)")
    return (
        trades.groupBy("symbol", slot.alias("t"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("qty").alias("volume"),
        )
        .withColumn("ts", from_micros("t"))
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trades: size = value, the maker bought when the user number is even."""
    return read(spark, sf, "events").select(
        F.col("event_type").alias("symbol"),
        micros("ts").alias("t"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.col("value").alias("qty"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )


def bars(spark: SparkSession, sf: str, interval_us: int = HOUR) -> DataFrame:
    return ohlcv(trades(spark, sf), interval_us)


def candles(spark: SparkSession, sf: str, interval_us: int = HOUR) -> DataFrame:
    """Bars as a written table, for queries that read them more than once: one scan of the trades."""
    return settle(bars(spark, sf, interval_us))


def funding(spark: SparkSession, sf: str) -> DataFrame:
    """One settlement every eight hours: the mean value of the bucket (symbol, t, rate)."""
    slot = F.col("t") - F.pmod(F.col("t"), F.lit(8 * HOUR))
    return (
        trades(spark, sf)
        .groupBy("symbol", slot.alias("t"))
        .agg(F.avg("qty").alias("rate"))
        .withColumn("ts", from_micros("t"))
    )


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as news items. The title is the whole text: nothing is cut."""
    from tidemark.functions.text import EVENT_TYPES

    d = F.col("doc_id")
    pub = F.lit(1_704_067_200_000_000) + ((d * 37) % 43200) * F.lit(MINUTE)
    pos = (d * 7 % 100) / F.lit(100.0) * F.lit(0.6)
    neg = (d * 13 % 100) / F.lit(100.0) * F.lit(0.4)
    kinds = F.array(*[F.lit(x) for x in EVENT_TYPES])
    return read(spark, sf, "documents").select(
        F.concat(F.lit("doc:"), d.cast("string")).alias("url"),
        "doc_id",
        "source",
        F.col("text").alias("title"),
        pub.alias("t"),
        from_micros(pub).alias("published_at"),
        F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (d % 5 + 1).cast("int")).alias("asset"),
        pos.alias("sentiment_pos"),
        neg.alias("sentiment_neg"),
        (1 - pos - neg).alias("sentiment_neu"),
        F.when(d % 11 != 0, F.element_at(kinds, (d % 10 + 1).cast("int"))).alias("llm_event_type"),
    )
