"""Streaming queries, run to the end of the input; their twins are the batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import tables as T
from tidemark.operators import features as X, orderflow as O, targets as Y
from tidemark.operators.blocks import from_micros
from tidemark.plans import joins as PJ
from tidemark.plans.features import RETS, TARGETS, r, rounded
from tidemark.plans.news import BATCH, batch
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, full, with_
from tidemark.session import fresh_dir, settle
from tidemark.streaming import jobs as J


def trades_stream(spark, sf):
    return J.read_stream(T.prepare(spark), sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.col("value").alias("qty"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )


# A window is out once the newest event minus ten minutes has passed its end.
CLOSED = "ts + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query("stream_bars", with_(BARS) + f"SELECT symbol, ts, {r(['open', 'high', 'low', 'close', 'volume'])} FROM bars WHERE {CLOSED}")
def stream_bars(spark, sf):
    return rounded(J.run(J.bars_stream(trades_stream(spark, sf)), fresh_dir(spark, "bars"), fresh_dir(spark, "ck")))


SOFI = PJ.OFI.replace("JOIN th ON th.symbol = e.event_type AND th.day = date_trunc('day', e.ts)", "LEFT JOIN th ON th.symbol = e.event_type AND th.day + INTERVAL 1 DAY = date_trunc('day', e.ts)")


@query("stream_ofi", with_(SOFI) + f"SELECT symbol, ts, n_trades, buy_cnt, sell_cnt, {r(PJ.VOLS)} FROM ofi WHERE {CLOSED}")
def stream_ofi(spark, sf):
    th = O.large_thresholds(T.trades(spark, sf))
    s = J.ofi_stream(trades_stream(spark, sf), th)
    return rounded(J.run(s, fresh_dir(spark, "ofi"), fresh_dir(spark, "ck")))


@query("stream_dedup", "SELECT DISTINCT source || '/' || (doc_id % 97) AS url FROM documents")
def stream_dedup(spark, sf):
    """Repeated urls inside the watermark come out once."""
    d = J.read_stream(T.prepare(spark), sf, "documents")
    k = F.col("doc_id")
    pub = F.lit(1_704_067_200_000_000) + ((k * 37) % 43200) * F.lit(T.MINUTE)
    items = d.select(F.concat("source", F.lit("/"), (k % 97).cast("string")).alias("url"), from_micros(pub).alias("published_at"))
    return J.run(J.dedup_stream(items), fresh_dir(spark, "news"), fresh_dir(spark, "ck")).select("url")


@query(
    "stream_matured",
    with_(BARS, RETS, TARGETS, f"\np AS (SELECT symbol, ts, {full('ret', 'avg', 6)} * 6 AS predicted FROM rets)")
    + "SELECT symbol, ts, round(predicted, 8) + 0.0 AS predicted, round(r_6, 8) + 0.0 AS actual FROM p JOIN tg USING (symbol, ts) WHERE r_6 IS NOT NULL AND predicted IS NOT NULL",
)
def stream_matured(spark, sf):
    """Six-hour predictions meet their outcome in a stream-stream join."""
    w = X.block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), 7).withColumn("ret", X.ret_col(w))
    d = d.withColumn("predicted", X.full(F.col("ret"), F.avg, w, 6) * 6)
    bars = J.written(X.owned(d, ["symbol", "ts", "close", "predicted"]), "bars")
    preds = J.stream_table(spark, bars).filter("predicted is not null").withColumnRenamed("close", "close0")
    out = J.run(J.matured_stream(preds, J.stream_table(spark, bars), 6 * T.HOUR), fresh_dir(spark, "matured"), fresh_dir(spark, "ck"))
    return rounded(out, 8)


@query(
    "stream_serving_features",
    with_(BARS, RETS, f"l AS (SELECT symbol, ts, {full('ret', 'avg', 36)} AS ret_mean_36, {full('volume', 'max', 144)} AS vol_max_144, lag(ret, 24) OVER (PARTITION BY symbol ORDER BY ts) AS ret_lag_24 FROM rets)")
    + f"SELECT symbol, ts, {r(['ret_mean_36', 'vol_max_144', 'ret_lag_24'])} FROM l",
)
def stream_serving_features(spark, sf):
    """Features from a state of 150 candles per symbol over several micro-batches, in time order.

    The compared columns look back less than the state, so they equal the batch job's exactly.
    """
    bars = settle(T.bars(spark, sf))
    src = fresh_dir(spark, "candles")
    first, last = bars.agg(F.min("t"), F.max("t")).first()
    edges = [first + (last + 1 - first) * i // 3 for i in range(4)]
    # Two files per third of the span, written one after the other: the stream reads them oldest first.
    for lo, hi in zip(edges, edges[1:]):
        bars.filter((F.col("t") >= lo) & (F.col("t") < hi)).repartition(2).write.mode("append").parquet(src)
    job = J.ServingFeatures(spark, fresh_dir(spark, "serving"))
    d = job.run(J.stream_table(spark, src, files_per_trigger=2), fresh_dir(spark, "ck"))
    return rounded(d.select("symbol", "ts", "ret_mean_36", "vol_max_144", "ret_lag_24"))


@query("stream_news_grid", with_(BARS, PJ.NEWS, PJ.DECAY) + f"SELECT symbol, ts, {r(PJ.N.DECAY_FEATURES)}, event_hack_60m, event_regulation_60m FROM dg")
def stream_news_grid(spark, sf):
    """Arriving candles get their trailing news features from the stored news table."""
    src = J.written(T.bars(spark, sf), "candles", files=2)
    out = fresh_dir(spark, "newsgrid")
    ev = {k: F.array_contains("kinds", k) for k in PJ.WORDS}
    job = J.NewsOnGrid(PJ.news_items(spark, sf), ev, out)
    J.run_batches(J.stream_table(spark, src, files_per_trigger=1), job, fresh_dir(spark, "ck"))
    d = spark.read.parquet(out).drop("batch").withColumn("ts", from_micros("t")).drop("t")
    return rounded(d)


@query("stream_upsert", f"WITH {BATCH} SELECT DISTINCT url FROM bt")
def stream_upsert(spark, sf):
    """Arriving items are added to the table unless their url is there; replays change nothing."""
    src = J.written(batch(spark, sf), "items", files=3)
    job = J.UpsertTable(spark, fresh_dir(spark, "table"), ["url"], ["doc_id"])
    J.run_batches(J.stream_table(spark, src, files_per_trigger=1), job, fresh_dir(spark, "ck"))
    return job.result().select("url")


@query("serve_parity")
def serve_parity(spark, sf):
    """Last candle of each symbol: features of the whole history against those of its last 150 rows."""
    bars = X.with_position(T.bars(spark, sf), X.KEYS, "t", T.HOUR * X.BLOCK_ROWS)
    top = bars.groupBy("symbol").agg(F.max("pos").alias("_top"))
    recent = bars.join(top, "symbol").filter(F.col("pos") > F.col("_top") - 150)
    names = [c for c in X.FEATURES]

    def last(df):
        last_t = df.groupBy("symbol").agg(F.max("t").alias("t"))
        d = X.features(df.drop("pos", "_top")).join(last_t, ["symbol", "t"])
        parts = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names]))
        return d.select("symbol", parts.alias("p")).select("symbol", "p.*")

    j = last(bars).withColumnRenamed("x", "full_x").join(last(recent).withColumnRenamed("x", "window_x"), ["symbol", "feature"])
    sd = X.features(bars.drop("pos")).groupBy("symbol").agg(*[F.stddev_samp(n).alias(n) for n in names])
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("sd")) for n in names]))
    sd = sd.select("symbol", parts.alias("p")).select("symbol", "p.*")
    diff = F.abs(F.col("full_x") - F.col("window_x"))
    return (
        j.join(sd, ["symbol", "feature"])
        .groupBy("feature")
        .agg(
            F.avg(diff / F.nullif(F.col("sd"), F.lit(0.0))).alias("mean_diff_in_sd"),
            F.max(diff / F.greatest(F.abs("full_x"), F.lit(1e-12))).alias("max_relative_diff"),
            F.count(F.when(F.col("full_x").isNotNull() & F.col("window_x").isNull(), 1)).alias("null_in_window_only"),
        )
    )
