"""Structured Streaming forms of ingest, bar building, serving features and maturing.

Every job takes a streaming DataFrame and writes tables under the shared folder; a restarted job goes
on from its checkpoint. ``run`` drives a job through all data that is there (``availableNow``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tidemark.operators import features as X, news as N, orderflow as O, upserts as U
from tidemark.operators.blocks import from_micros, micros
from tidemark.session import fresh_dir, settle
from tidemark.tables import DAY, HOUR


def read_stream(spark: SparkSession, sf: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """One of the given tables, a file or a folder of part files, as a stream of files."""
    # A pattern: a stream takes a plain path for a folder, and a filter of names sees the part files only.
    return file_stream(spark, f"{sf}/{name}.parque[t]", spark.read.parquet(f"{sf}/{name}.parquet").schema, files_per_trigger)


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A written table as a stream."""
    return file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger)


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def run(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append the stream to a table until the input is used up, and return the table."""
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


# State of own processors lives in RocksDB stores, which write their changes beside the checkpoint. No batches without
# data: in processing time each would call for another one, and a run to the end of the input would have no end.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The settings of a stream with an own processor, put back afterwards."""
    was = {k: spark.conf.get(k, None) for k in KEYED_STATE}
    for k, v in KEYED_STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def instant(c: Column) -> Column:
    """Event-time columns carry a zone (UTC) inside a stream."""
    return c.cast("timestamp")


def dedup_stream(items: DataFrame, key: str = "url", event_time: str = "published_at", delay: str = "24 hours") -> DataFrame:
    """News without repeats of a key inside the watermark; the state of older keys is dropped."""
    return items.withColumn(event_time, instant(F.col(event_time))).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def bars_stream(trades: DataFrame, interval: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Trades (symbol, ts, seq, price, qty) to candles; a candle comes out once its window is closed."""
    order = F.struct("ts", "seq")
    d = trades.withColumn("ts", instant(F.col("ts"))).withWatermark("ts", delay)
    return (
        d.groupBy(F.window("ts", interval).alias("w"), "symbol")
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"),
        )
        .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
    )


def ofi_stream(trades: DataFrame, thresholds: DataFrame, interval: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Order-flow bars; "large" is measured by the *previous* day's threshold, which is known in time.

    ``thresholds`` is a static table (symbol, day, large_qty), day in microseconds. A day without a
    threshold counts no trade as large.
    """
    prev = thresholds.select("symbol", (F.col("day") + F.lit(24 * HOUR)).alias("day"), "large_qty")
    d = trades.withColumn("day", O.day_of(micros("ts"))).join(prev, ["symbol", "day"], "left")
    d = d.withColumn("ts", instant(F.col("ts"))).withWatermark("ts", delay)
    g = d.groupBy(F.window("ts", interval).alias("w"), "symbol").agg(*O.flow_aggs())
    return g.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), *[c for c in g.columns if c not in ("w", "symbol")])


def matured_stream(predictions: DataFrame, actuals: DataFrame, horizon_us: int, delay: str = "10 minutes") -> DataFrame:
    """Predictions (symbol, ts, predicted, close0) joined with the close at ts + horizon.

    Both sides are watermarked and the join is an equality on time, so state ends with the watermark;
    an actual later than that is lost, as a matured score would be.
    """
    p = predictions.select(
        F.col("symbol").alias("p_symbol"), instant(F.col("ts")).alias("p_ts"), "predicted", "close0",
        instant(from_micros(micros("ts") + F.lit(horizon_us))).alias("due"),
    ).withWatermark("due", delay)
    a = actuals.select("symbol", instant(F.col("ts")).alias("a_ts"), F.col("close").alias("close1")).withWatermark("a_ts", delay)
    on = (F.col("symbol") == F.col("p_symbol")) & (F.col("a_ts") == F.col("due"))
    return p.join(a, on).select(
        "symbol", F.col("p_ts").cast("timestamp_ntz").alias("ts"), "predicted", X.log_ratio(F.col("close1"), F.col("close0")).alias("actual")
    )


class LastCandles(StatefulProcessor):
    """Per symbol the newest ``rows`` candles as keyed state; puts them beside the arriving ones, marked as not new.

    What is held per symbol in a batch is ``rows`` candles, however many arrive. A candle that comes again replaces the
    kept one of its time; a late candle is kept if it belongs to the newest. A symbol without candles for ``ttl_ms`` is
    forgotten. Candles without a time pass through and are not kept.
    """

    def __init__(self, schema: StructType, rows: int, ttl_ms: int):
        self.schema, self.rows, self.ttl_ms, self.t = schema, rows, ttl_ms, schema.names.index("t")
        self.out = Row(*schema.names, "is_new")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("candles", self.schema, self.ttl_ms)

    def newest(self, by_time: dict) -> dict:
        return dict(sorted(by_time.items())[-self.rows :])

    def handleInputRows(self, key, rows, timerValues):
        held = {r[self.t]: tuple(r) for r in self.state.get()}
        kept, again = dict(held), set()
        for r in rows:
            r = tuple(r)
            yield self.out(*r, True)
            if r[self.t] is None:
                continue
            if r[self.t] in held:
                again.add(r[self.t])
            kept[r[self.t]] = r
            if len(kept) >= 4 * self.rows:
                kept = self.newest(kept)
        for t, r in held.items():
            if t not in again:
                yield self.out(*r, False)
        kept = self.newest(kept)
        if kept:
            self.state.put(list(kept.values()))

    def close(self) -> None:
        pass


class ServingFeatures:
    """Features of arriving candles (symbol, t, ...) from the last ``rows`` candles per symbol.

    The kept candles are the keyed state of the stream, saved with its checkpoint, so a replayed batch starts from the
    state before it. A batch and its kept candles go through the same feature operator as the batch job, so serving and
    training cannot drift apart; only the means' start differs, and that has faded. A batch's rows are one folder of the
    result, overwritten on replay. Empty batches write no rows.
    """

    def __init__(self, spark: SparkSession, base: str, rows: int = 150, interval_us: int = HOUR, ttl_ms: int = 90 * DAY // 1000):
        self.spark, self.base, self.rows, self.interval, self.ttl_ms = spark, base, rows, interval_us, ttl_ms

    def with_kept(self, candles: DataFrame) -> DataFrame:
        """The stream of candles, each batch with the kept candles of its symbols (``is_new`` tells them apart)."""
        out = StructType([*candles.schema.fields, StructField("is_new", BooleanType())])
        return candles.groupBy("symbol").transformWithState(
            LastCandles(candles.schema, self.rows, self.ttl_ms), out, outputMode="Append", timeMode="ProcessingTime"
        )

    def __call__(self, both: DataFrame, batch: int) -> None:
        # Positions are counted before the windows: the batch is written once, so that the state is asked once.
        f = X.features(settle(both), self.interval).filter("is_new").drop("is_new")
        f.write.mode("overwrite").parquet(f"{self.base}/features/batch={batch}")

    def run(self, candles: DataFrame, checkpoint: str) -> DataFrame:
        """Drive the stream through all candles that are there, and return the features of all batches."""
        with keyed_state(self.spark):
            run_batches(self.with_kept(candles), self, checkpoint)
        return self.result()

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/features").drop("batch")


class NewsOnGrid:
    """Decay features of arriving candles against the news of the batch's own span and of the windows before it."""

    def __init__(self, news: DataFrame, events: dict[str, Column], out: str, step_us: int = HOUR, reach_us: int = 25 * HOUR):
        self.news, self.events, self.out, self.step, self.reach = news, events, out, step_us, reach_us

    def __call__(self, candles: DataFrame, batch: int) -> None:
        span = candles.agg(F.min("t"), F.max("t")).first()
        if span[0] is None:
            return
        # Only news that can reach a candle of the batch: what is older than the longest window is out.
        news = self.news.filter(F.col("t").between(span[0] - self.reach, span[1] + self.step))
        d = N.decay_features(news, candles, ["symbol"], self.step, self.events)
        d.write.mode("overwrite").parquet(f"{self.out}/batch={batch}")


class UpsertTable:
    """Insert-ignore of arriving rows into a table of key buckets and merged runs.

    A batch adds a run of its new rows, cut into ``buckets`` by a hash of the key, and looks for its keys only in the
    buckets that they fall into. As soon as ``fan`` runs of one level are there they are merged into one of the next, so
    n batches leave at most (fan - 1) * log_fan(n) + 1 runs to look into, and a row is rewritten log_fan(n) times.

    What the table holds after a batch is a list of runs, written last. A replayed batch starts from the list before it
    and overwrites its own run and list, so a restart gives the same table; runs go only when no list that a replay may
    start from names them.
    """

    def __init__(self, spark: SparkSession, base: str, keys: list[str], order: list[str], buckets: int = 64, fan: int = 8):
        self.spark, self.base, self.keys, self.order, self.buckets, self.fan = spark, base, keys, order, buckets, fan

    def runs(self, batch: int) -> list[tuple[str, int]]:
        """(run, level) after a batch, oldest first."""
        if batch < 0:
            return []
        return [(r.run, r.level) for r in self.spark.read.parquet(f"{self.base}/lists/batch={batch}").orderBy("at").collect()]

    def _read(self, runs: list[tuple[str, int]], schema) -> DataFrame:
        full = StructType([*schema.fields, StructField("_bucket", IntegerType())])
        paths = [f"{self.base}/runs/{r}" for r, _ in runs]
        # One read per run: each has bucket folders of its own.
        parts = [self.spark.read.schema(full).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], full)

    def _write(self, rows: DataFrame, run: str) -> None:
        rows.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.base}/runs/{run}")

    def _forget(self, folders: list[str]) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in folders:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{f}")
            path.getFileSystem(conf).delete(path, True)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        schema = StructType([f for f in rows.schema.fields if f.name != "_bucket"])
        before = self.runs(batch - 1)
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
        known = self._read(before, schema).filter(F.col("_bucket").isin(touched))
        self._write(U.insert_ignore(known, rows, self.keys, self.order), f"batch-{batch}")
        now = [*before, (f"batch-{batch}", 0)]
        made = {f"batch-{batch}"}
        while len(now) >= self.fan and len({level for _, level in now[-self.fan :]}) == 1:
            level = now[-1][1] + 1
            merged = f"merged-{batch}-{level}"
            self._write(self._read(now[-self.fan :], schema), merged)
            now = [*now[: -self.fan], (merged, level)]
            made.add(merged)
        listed = self.spark.createDataFrame([(i, *r, schema.json()) for i, r in enumerate(now)], "at int, run string, level int, schema string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/lists/batch={batch}")
        self._forget([f"runs/{r}" for r in made - {r for r, _ in now}])
        if batch > 1 and self._has(batch - 2):
            needed = {r for r, _ in before + now}
            gone = [r for r, _ in self.runs(batch - 2) if r not in needed]
            self._forget([*(f"runs/{r}" for r in gone), f"lists/batch={batch - 2}"])

    def _has(self, batch: int) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/lists/batch={batch}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def result(self) -> DataFrame:
        """The table after the newest batch."""
        newest = self.spark.read.parquet(f"{self.base}/lists").agg(F.max_by("schema", "batch"), F.max("batch")).first()
        return self._read(self.runs(newest[1]), StructType.fromJson(json.loads(newest[0]))).drop("_bucket")


def written(df: DataFrame, name: str, files: int = 1) -> str:
    """Write a table to the shared folder so that it can be read as a stream."""
    path = fresh_dir(df.sparkSession, name)
    df.repartition(files).write.parquet(path)
    return path
