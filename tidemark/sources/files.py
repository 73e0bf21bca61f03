"""File readers and append sinks: trade dumps, caches, fold tables, audit lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Column order of a headerless trade dump.
TRADE_DUMP = (
    "agg_id long, price double, qty double, first_id long, last_id long, transact_time long, "
    "is_buyer_maker boolean, is_best_match boolean"
)


def epoch_to_micros(value: Column) -> Column:
    """Epoch number in s, ms, us or ns to microseconds, the unit read from its magnitude."""
    return (
        F.when(value > 100_000_000_000_000_000, F.floor(value / 1000).cast("long"))
        .when(value > 100_000_000_000_000, value)
        .when(value > 100_000_000_000, value * 1000)
        .otherwise(value * 1_000_000)
    )


def read_trade_dump(spark: SparkSession, path: str) -> DataFrame:
    """Headerless dumps under ``path`` (a symbol partition folder each) to trades.

    The unit is decided per row, so files from before and after a precision change mix freely.
    """
    d = spark.read.schema(TRADE_DUMP + ", symbol string").csv(path)
    return d.select("symbol", epoch_to_micros(F.col("transact_time")).alias("t"), "qty", "is_buyer_maker")


def read_cache(spark: SparkSession, path: str, order: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(order)


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """A fold or report table with a given schema; a path without files is an empty table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    r = spark.read.schema(schema)
    return r.csv(path, header=True) if fmt == "csv" else r.json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def append_audit(df: DataFrame, path: str) -> None:
    """One JSON line per decision."""
    df.write.mode("append").json(path)


def write_cache(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)
