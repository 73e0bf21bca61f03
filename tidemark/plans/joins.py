"""Queries on order flow, funding, as-of joins, labels and news on the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import tables as T
from tidemark.functions import text as X
from tidemark.operators import features as FE, funding as FU, news as N, novelty as V, orderflow as O, targets as Y
from tidemark.operators.asof import asof
from tidemark.plans.features import RETS, TARGETS, r, rounded
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, full, with_

# Ten-day z window and ten rows so that a month of data shows full, partial and empty windows.
ZW, ZMIN = 10 * T.DAY, 10

FUNDING = """
funding AS (SELECT event_type AS symbol, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2000-01-01') AS ts, avg(value) AS rate FROM events GROUP BY 1, 2),
fz AS (SELECT symbol, ts, rate, CASE WHEN count(rate) OVER w >= 10 THEN (rate - avg(rate) OVER w) / nullif(stddev_samp(rate) OVER w, 0) END AS f_z
  FROM funding WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 863999999999 MICROSECOND PRECEDING AND CURRENT ROW))"""


@query("funding_z", with_(FUNDING) + "SELECT symbol, ts, round(rate, 6) AS rate, round(f_z, 6) + 0.0 AS f_z FROM fz")
def funding_z(spark, sf):
    return rounded(FU.funding_z(T.funding(spark, sf), ZW, ZMIN).select("symbol", "ts", "rate", "f_z"))


FASOF = """
fa AS (SELECT b.symbol, b.ts, f.ts AS funding_ts, f.rate AS f_rate, f.f_z FROM bars b ASOF LEFT JOIN fz f ON f.symbol = b.symbol AND f.ts <= b.ts)"""


@query(
    "funding_asof",
    with_(BARS, FUNDING, FASOF) + "SELECT symbol, ts, funding_ts, round(f_rate, 6) AS f_rate, round(f_z, 6) + 0.0 AS f_z, round(abs(f_z), 6) AS f_absz FROM fa",
)
def funding_asof(spark, sf):
    from tidemark.operators.blocks import from_micros

    d = FU.attach_funding(T.bars(spark, sf), T.funding(spark, sf), ZW, ZMIN)
    return rounded(d.select("symbol", "ts", from_micros("funding_t").alias("funding_ts"), "f_rate", "f_z", "f_absz"))


PER = """
per AS (SELECT f.symbol, f.ts, f.f_z, CASE WHEN b.ts - f.ts <= INTERVAL 2 HOUR THEN b.ts END AS bar_ts, CASE WHEN b.ts - f.ts <= INTERVAL 2 HOUR THEN b.r_6 END AS r_6, CASE WHEN b.ts - f.ts <= INTERVAL 2 HOUR THEN b.r_12 END AS r_12
  FROM fz f ASOF LEFT JOIN tg b ON b.symbol = f.symbol AND b.ts >= f.ts)"""


def settlements(spark, sf):
    """Settlements with z, and the targets of the first bar within two hours."""
    z = FU.funding_z(T.funding(spark, sf), ZW, ZMIN)
    t = Y.targets(T.bars(spark, sf), (6, 12)).select("symbol", "t", "r_6", "r_12")
    return FU.settlement_panel(z, t, ["r_6", "r_12"], 2 * T.HOUR)


@query(
    "settlement_forward",
    with_(BARS, TARGETS, FUNDING, PER) + "SELECT symbol, ts, bar_ts, round(f_z, 6) + 0.0 AS f_z, round(r_6, 9) + 0.0 AS r_6, round(r_12, 9) + 0.0 AS r_12 FROM per",
)
def settlement_forward(spark, sf):
    from tidemark.operators.blocks import from_micros

    d = settlements(spark, sf)
    return d.select(
        "symbol", "ts", from_micros("bar_t").alias("bar_ts"), (F.round("f_z", 6) + 0.0).alias("f_z"),
        *[(F.round(c, 9) + 0.0).alias(c) for c in ("r_6", "r_12")],
    )


# --- order flow -----------------------------------------------------------------------------------
OFI = """
th AS (SELECT event_type AS symbol, date_trunc('day', ts) AS day, quantile_cont(value, 0.9) AS large_qty FROM events GROUP BY 1, 2),
ofi AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, count(*) AS n_trades, sum(value) AS total_vol,
  sum(CASE WHEN user_id % 2 <> 0 THEN value ELSE 0 END) AS buy_vol, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS sell_vol,
  count(*) FILTER (user_id % 2 <> 0) AS buy_cnt, count(*) FILTER (user_id % 2 = 0) AS sell_cnt,
  sum(CASE WHEN user_id % 2 <> 0 AND value >= large_qty THEN value ELSE 0 END) AS large_buy_vol, sum(CASE WHEN user_id % 2 = 0 AND value >= large_qty THEN value ELSE 0 END) AS large_sell_vol
  FROM events e JOIN th ON th.symbol = e.event_type AND th.day = date_trunc('day', e.ts) GROUP BY 1, 2)"""
VOLS = ["total_vol", "buy_vol", "sell_vol", "large_buy_vol", "large_sell_vol"]


@query("ofi_bars", with_(OFI) + f"SELECT symbol, ts, n_trades, buy_cnt, sell_cnt, {r(VOLS)} FROM ofi")
def ofi_bars(spark, sf):
    return rounded(O.ofi_bars(T.trades(spark, sf)).drop("t"))


OFIR = """
orr AS (SELECT *, (buy_vol - sell_vol) / nullif(buy_vol + sell_vol, 0) AS ofi_vol, (buy_cnt - sell_cnt) / nullif(buy_cnt + sell_cnt, 0) AS ofi_cnt,
  (large_buy_vol - large_sell_vol) / nullif(large_buy_vol + large_sell_vol, 0) AS ofi_large, total_vol / nullif(n_trades, 0) AS avg_trade_size FROM ofi)"""


@query(
    "ofi_ratios",
    with_(OFI, OFIR) + f"SELECT symbol, ts, {r(['ofi_vol', 'ofi_cnt', 'ofi_large', 'avg_trade_size'])} FROM orr",
)
def ofi_ratios(spark, sf):
    d = FE.ofi_ratios(O.ofi_bars(T.trades(spark, sf)))
    return rounded(d.select("symbol", "ts", "ofi_vol", "ofi_cnt", "ofi_large", "avg_trade_size"))


OFIF = f"""
o1 AS (SELECT *, {full('ofi_vol', 'avg', 12)} AS v12, {full('ofi_vol', 'avg', 36)} AS v36, {full('ofi_cnt', 'avg', 12)} AS c12,
  n_trades / nullif({full('n_trades', 'avg', 36)}, 0) AS it, (avg_trade_size - {full('avg_trade_size', 'avg', 288)}) / nullif({full('avg_trade_size', 'stddev_samp', 288)}, 0) AS z FROM orr),
of AS (SELECT symbol, ts, lag(ofi_vol) OVER w AS ofi_vol_lag1, lag(ofi_cnt) OVER w AS ofi_cnt_lag1, lag(ofi_large) OVER w AS ofi_large_lag1, lag(v12) OVER w AS ofi_vol_roll12,
  lag(v36) OVER w AS ofi_vol_roll36, lag(c12) OVER w AS ofi_cnt_roll12, lag(it) OVER w AS trade_intensity_lag1, lag(z) OVER w AS avg_trade_size_z_lag1 FROM o1 WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query("ofi_features", with_(OFI, OFIR, OFIF) + f"SELECT symbol, ts, {r(FE.OFI)} FROM of")
def ofi_features(spark, sf):
    return rounded(FE.ofi_features(O.ofi_bars(T.trades(spark, sf))).select("symbol", "ts", *FE.OFI))


@query(
    "ofi_on_bars",
    with_(BARS, OFI, OFIR, OFIF) + f"SELECT b.symbol, b.ts, round(b.close, 6) AS close, {r(FE.OFI)} FROM bars b LEFT JOIN of USING (symbol, ts)",
)
def ofi_on_bars(spark, sf):
    """Exact left join of the flow features onto bars."""
    from tidemark.operators.models import FEATURE_SETS

    d, names = FEATURE_SETS["ofi"](T.bars(spark, sf), {"trades": T.trades(spark, sf)})
    return rounded(d.select("symbol", "ts", "close", *names))


# --- news -----------------------------------------------------------------------------------------
KINDS = "[" + ", ".join(f"'{k}'" for k in X.EVENT_TYPES) + "]"
NEWS = f"""
news AS (SELECT 'doc:' || doc_id AS url, doc_id, source, text AS title, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * ((doc_id * 37) % 43200) AS published_at,
  ['click', 'error', 'purchase', 'signup', 'view'][doc_id % 5 + 1] AS symbol, (doc_id * 7 % 100) / 100.0 * 0.6 AS pos, (doc_id * 13 % 100) / 100.0 * 0.4 AS neg,
  1 - (doc_id * 7 % 100) / 100.0 * 0.6 - (doc_id * 13 % 100) / 100.0 * 0.4 AS neu, CASE WHEN doc_id % 11 <> 0 THEN {KINDS}[doc_id % 10 + 1] END AS llm_event_type FROM documents)"""


def word_sql(groups, col="title"):
    return {
        k: f"regexp_matches({col}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(v)})([^\\p{{L}}\\p{{N}}_]|$)')" for k, v in groups.items()
    }


# The texts are invented prose, so the keyword lists are words of that prose.
WORDS = {"hack": ["the", "que", "der"], "regulation": ["and", "les", "und", "sur"]}


def news_items(spark, sf):
    d = T.news(spark, sf).withColumnRenamed("asset", "symbol")
    return d.withColumn("kinds", X.tags(F.col("title"), WORDS))


@query(
    "news_labels",
    with_(BARS, NEWS, "\nst AS (SELECT symbol, ts, close AS entry_close, lead(close, 12) OVER (PARTITION BY symbol ORDER BY ts) AS exit_close FROM bars)",
          "\nnl AS (SELECT n.url, n.symbol, n.published_at, ln(s.exit_close / s.entry_close) AS log_return FROM news n ASOF JOIN st s ON s.symbol = n.symbol AND s.ts >= n.published_at WHERE s.exit_close IS NOT NULL)")
    + "SELECT url, symbol, published_at, round(log_return, 9) + 0.0 AS log_return, CASE WHEN log_return > 0.0015 THEN 'positive' WHEN log_return < -0.0015 THEN 'negative' ELSE 'neutral' END AS label FROM nl",
)
def news_labels(spark, sf):
    d = Y.label_news(news_items(spark, sf).select("url", "symbol", "published_at", "t"), T.bars(spark, sf))
    return rounded(d.select("url", "symbol", "published_at", "log_return", "label"), 9)


@query(
    "label_balance",
    with_(BARS, NEWS, "\nst AS (SELECT symbol, ts, close AS entry_close, lead(close, 12) OVER (PARTITION BY symbol ORDER BY ts) AS exit_close FROM bars)",
          "\nnl AS (SELECT n.symbol, ln(s.exit_close / s.entry_close) AS log_return FROM news n ASOF JOIN st s ON s.symbol = n.symbol AND s.ts >= n.published_at WHERE s.exit_close IS NOT NULL)")
    + "SELECT symbol, count(*) FILTER (log_return < -0.0015) AS negative, count(*) FILTER (log_return BETWEEN -0.0015 AND 0.0015) AS neutral, count(*) FILTER (log_return > 0.0015) AS positive FROM nl GROUP BY 1",
)
def label_balance(spark, sf):
    d = Y.label_news(news_items(spark, sf).select("url", "symbol", "published_at", "t"), T.bars(spark, sf))
    return d.groupBy("symbol").pivot("label", ["negative", "neutral", "positive"]).count().fillna(0)


DECAY_LAM = "ln(2) / 90.0"
W = word_sql(WORDS, "n.title")
DECAY = f"""
dc AS (SELECT b.symbol, b.ts, exp(-{DECAY_LAM} * epoch(b.ts - n.published_at) / 60) AS w, n.pos - n.neg AS s, 1 - n.neu AS mag,
  n.published_at >= b.ts - INTERVAL 60 MINUTE AS recent, n.published_at IS NOT NULL AS hit, {W['hack']} AS hack, {W['regulation']} AS regulation
  FROM bars b LEFT JOIN news n ON n.symbol = b.symbol AND n.published_at <= b.ts AND n.published_at >= b.ts - INTERVAL 24 HOUR),
dg AS (SELECT symbol, ts, coalesce(sum(w * s), 0) AS sentiment_weighted, coalesce(sum(w), 0) AS news_intensity, coalesce(max(mag) FILTER (recent), 0) AS max_magnitude_60m,
  coalesce(sqrt(greatest(sum(w * s * s) / sum(w) - (sum(w * s) / sum(w))^2, 0)), 0) AS sentiment_dispersion,
  coalesce(bool_or(hack) FILTER (recent), false) AS event_hack_60m, coalesce(bool_or(regulation) FILTER (recent), false) AS event_regulation_60m FROM dc GROUP BY 1, 2)"""


def decayed(spark, sf):
    ev = {k: F.array_contains("kinds", k) for k in WORDS}
    return N.decay_features(news_items(spark, sf), T.bars(spark, sf), ["symbol"], T.HOUR, ev)


@query("news_decay", with_(BARS, NEWS, DECAY) + f"SELECT symbol, ts, {r(N.DECAY_FEATURES)}, event_hack_60m, event_regulation_60m FROM dg")
def news_decay(spark, sf):
    from tidemark.operators.blocks import from_micros

    d = decayed(spark, sf).withColumn("ts", from_micros("t")).drop("t")
    # Dispersion comes from a difference of sums: the last bits of a zero are not zero.
    return rounded(d)


def _flags_sql(minutes, suffix):
    cols = ", ".join(f"coalesce(bool_or(n.llm_event_type = '{k}'), false) AS event_llm_{k}_{suffix}" for k in X.EVENT_TYPES)
    return with_(BARS, NEWS) + f"SELECT b.symbol, b.ts, {cols} FROM bars b LEFT JOIN news n ON n.symbol = b.symbol AND n.published_at <= b.ts AND n.published_at >= b.ts - INTERVAL {minutes} MINUTE GROUP BY 1, 2"


def _flags(spark, sf, minutes, suffix):
    from tidemark.operators.blocks import from_micros

    d = N.event_flags(news_items(spark, sf), T.bars(spark, sf), ["symbol"], T.HOUR, minutes, suffix)
    return d.withColumn("ts", from_micros("t")).drop("t")


@query("event_flags_60m", _flags_sql(60, "60m"))
def event_flags_60m(spark, sf):
    return _flags(spark, sf, 60, "60m")


@query("event_flags_24h", _flags_sql(1440, "24h"))
def event_flags_24h(spark, sf):
    return _flags(spark, sf, 1440, "24h")


RECENT = """
rc AS (SELECT b.symbol, b.ts, coalesce(arg_max(n.llm_event_type, struct_pack(a := n.published_at, b := n.url)), 'none') AS recent_category
  FROM bars b LEFT JOIN news n ON n.symbol = b.symbol AND n.llm_event_type IS NOT NULL AND n.published_at <= b.ts AND n.published_at >= b.ts - INTERVAL 180 MINUTE GROUP BY 1, 2)"""


def recent(spark, sf, minutes=180):
    return N.recent_category(news_items(spark, sf), T.bars(spark, sf), ["symbol"], T.HOUR, minutes)


@query("recent_category", with_(BARS, NEWS, RECENT) + "SELECT symbol, ts, recent_category FROM rc")
def recent_category(spark, sf):
    from tidemark.operators.blocks import from_micros

    return recent(spark, sf).withColumn("ts", from_micros("t")).drop("t")


# --- novelty --------------------------------------------------------------------------------------
def vectors(spark, sf):
    t = F.lit(1_704_067_200_000_000) + F.col("vec_id") * F.lit(31 * T.MINUTE)
    return T.read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), t.cast("long").alias("t"), F.col("label").alias("asset"), F.col("embedding").alias("vec")
    )


VEC = """
vec AS (SELECT vec_id AS id, label AS asset, TIMESTAMP '2024-01-01' + INTERVAL 31 MINUTE * vec_id AS p, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv FROM embeddings),
nov AS (SELECT x.id, x.asset, coalesce(1 - max(list_dot_product(x.v, y.v) / (x.nv * y.nv)), 1) AS novelty, count(y.id) AS news_count_24h FROM vec x LEFT JOIN vec y ON y.asset = x.asset AND y.p < x.p AND y.p >= x.p - INTERVAL 24 HOUR GROUP BY 1, 2)"""


@query("novelty_24h", with_(VEC) + "SELECT id, asset, round(novelty, 6) AS novelty, news_count_24h FROM nov")
def novelty_24h(spark, sf):
    return rounded(V.novelty(vectors(spark, sf), ["asset"]).drop("t"))


@query(
    "novelty_residual",
    with_(VEC)
    + """, f AS (SELECT asset, regr_slope(novelty, news_count_24h) AS b, regr_intercept(novelty, news_count_24h) AS a, avg(novelty) AS m FROM nov GROUP BY 1)
    SELECT id, asset, round(novelty - coalesce(a + b * news_count_24h, m), 6) + 0.0 AS novelty_resid FROM nov JOIN f USING (asset)""",
)
def novelty_residual(spark, sf):
    """Novelty without the part a straight line on the item count explains."""
    from tidemark.operators.stats import residualise

    d = residualise(V.novelty(vectors(spark, sf), ["asset"]), ["asset"], "novelty", "news_count_24h", "novelty_resid")
    return rounded(d.select("id", "asset", "novelty_resid"))


@query(
    "novelty_profile",
    with_(VEC)
    + """SELECT asset, count(*) AS n, round(avg(novelty), 6) AS mean_x, round(stddev_samp(novelty), 6) AS std_x, round(avg(news_count_24h), 6) AS mean_y,
    round(corr(novelty, news_count_24h), 6) + 0.0 AS corr_xy FROM nov GROUP BY 1""",
)
def novelty_profile(spark, sf):
    from tidemark.operators.stats import profile

    return rounded(profile(V.novelty(vectors(spark, sf), ["asset"]), ["asset"], "novelty", "news_count_24h"))
