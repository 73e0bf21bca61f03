"""Queries on bars, candle features and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import tables as T
from tidemark.operators import features as X, targets as Y
from tidemark.operators.blocks import block_window
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, RETS, full, with_

ID = ["symbol", "ts"]


def rounded(df, digits: int = 6):
    """Doubles rounded so that two engines' last digits do not matter; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(cols, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


@query("bars_1h", with_(BARS) + f"SELECT symbol, ts, {r(['open', 'high', 'low', 'close', 'volume'])} FROM bars")
def bars_1h(spark, sf):
    return rounded(T.bars(spark, sf).drop("t"))


@query("symbol_list", "SELECT DISTINCT event_type AS symbol FROM events ORDER BY 1")
def symbol_list(spark, sf):
    from tidemark.sources.candles import list_symbols

    return list_symbols(T.bars(spark, sf))


@query(
    "candle_range",
    with_(BARS)
    + f"""SELECT symbol, ts, {r(['open', 'high', 'low', 'close', 'volume'])} FROM bars
    WHERE symbol = 'click' AND ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-22 12:00:00'""",
)
def candle_range(spark, sf):
    from tidemark.sources.candles import load_candles

    bars = T.bars(spark, sf)
    return rounded(load_candles(bars, "click", "2024-01-08", "2024-01-22 12:00:00").drop("t"))


@query("log_returns", with_(BARS, RETS) + f"SELECT symbol, ts, {r(['ret'], 9)} FROM rets")
def log_returns(spark, sf):
    d = X.blocked(T.bars(spark, sf), 1).withColumn("ret", X.ret_col(block_window(X.KEYS, "t")))
    return rounded(X.owned(d, [*ID, "ret"]), 9)


@query(
    "time_features",
    with_(BARS)
    + """SELECT symbol, ts,
      round(sin(2*pi()*(hour(ts)+minute(ts)/60.0)/24), 9) + 0.0 AS hour_sin,
      round(cos(2*pi()*(hour(ts)+minute(ts)/60.0)/24), 9) + 0.0 AS hour_cos,
      round(sin(2*pi()*(isodow(ts)-1)/7), 9) + 0.0 AS dow_sin,
      round(cos(2*pi()*(isodow(ts)-1)/7), 9) + 0.0 AS dow_cos FROM bars""",
)
def time_features(spark, sf):
    d = T.bars(spark, sf).withColumns(X.clock_cols())
    return rounded(d.select(*ID, "hour_sin", "hour_cos", "dow_sin", "dow_cos"), 9)


def _lag_sql():
    cols = [f"lag(ret, {k}) OVER w AS ret_lag_{k}, lag(volume, {k}) OVER w AS vol_lag_{k}" for k in X.LAGS]
    names = [f"{x}_lag_{k}" for k in X.LAGS for x in ("ret", "vol")]
    return (
        with_(BARS, RETS, f"l AS (SELECT symbol, ts, {', '.join(cols)} FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts))")
        + f"SELECT symbol, ts, {r(names)} FROM l"
    )


@query("lag_features", _lag_sql())
def lag_features(spark, sf):
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), 25).withColumn("ret", X.ret_col(w)).withColumns(X.lag_cols(w))
    return rounded(X.owned(d, [*ID, *[f"{x}_lag_{k}" for k in X.LAGS for x in ("ret", "vol")]]))


ROLL_NAMES = [f"{x}_{s}_{n}" for n in X.ROLLING for x in ("ret", "vol") for s in ("mean", "std", "min", "max")]


def roll_exprs() -> list[str]:
    aggs = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return [
        full("ret" if x == "ret" else "volume", aggs[s], n) + f" AS {x}_{s}_{n}"
        for n in X.ROLLING
        for x in ("ret", "vol")
        for s in ("mean", "std", "min", "max")
    ]


@query(
    "rolling_stats",
    with_(BARS, RETS, f"l AS (SELECT symbol, ts, {', '.join(roll_exprs())} FROM rets)")
    + f"SELECT symbol, ts, {r(ROLL_NAMES)} FROM l",
)
def rolling_stats(spark, sf):
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), 145).withColumn("ret", X.ret_col(w)).withColumns(X.rolling_cols(w))
    return rounded(X.owned(d, [*ID, *ROLL_NAMES]))


@query(
    "bollinger_width",
    with_(BARS, f"l AS (SELECT symbol, ts, 4 * ({full('close', 'stddev_pop', 20)}) / ({full('close', 'avg', 20)}) AS bb_width FROM bars)")
    + f"SELECT symbol, ts, {r(['bb_width'])} FROM l",
)
def bollinger_width(spark, sf):
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), 20).withColumn("bb_width", X.band_width(w))
    return rounded(X.owned(d, [*ID, "bb_width"]))


@query(
    "obv_roc",
    with_(BARS, RETS, "s AS (SELECT *, sign(step) * volume AS sv FROM rets)",
          f"l AS (SELECT symbol, ts, ({full('sv', 'sum', 36)}) / nullif({full('volume', 'sum', 36)}, 0) AS obv_roc_36 FROM s)")
    + f"SELECT symbol, ts, {r(['obv_roc_36'])} FROM l",
)
def obv_roc(spark, sf):
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), 37).withColumns(X.change_cols(w)).withColumn("obv_roc_36", X.obv_col(w))
    return rounded(X.owned(d, [*ID, "obv_roc_36"]))


# --- recursive means: the twin walks the rows one by one -----------------------------------------
def rec_ema(name: str, src: str, value: str, alpha: float, seed: int = 0) -> str:
    """Recursive CTE of y = (1-a) y + a x over (symbol, pos) of ``src``, started at ``seed``."""
    return f"""
{name} AS (
  SELECT symbol, pos, CAST({value} AS DOUBLE) AS y FROM {src} WHERE pos = {seed}
  UNION ALL
  SELECT s.symbol, s.pos, p.y * (1 - {alpha!r}) + s.{value} * {alpha!r} FROM {name} p JOIN {src} s ON s.symbol = p.symbol AND s.pos = p.pos + 1)"""


@query(
    "ema_12",
    with_(BARS, RETS, rec_ema("e", "rets", "close", 2 / 13), recursive=True)
    + "SELECT r.symbol, r.ts, round(CASE WHEN r.pos >= 11 THEN e.y END, 6) AS ema_12 FROM rets r JOIN e USING (symbol, pos)",
)
def ema_12(spark, sf):
    from tidemark.operators.blocks import ema

    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), X.EMA_HALO)
    d = d.withColumn("ema_12", F.when(F.col("pos") >= 11, ema(F.col("close"), 2 / 13, w)))
    return rounded(X.owned(d, [*ID, "ema_12"]))


@query(
    "rsi_14",
    with_(BARS, RETS, "g AS (SELECT symbol, ts, pos, coalesce(greatest(step, 0), 0) AS up, coalesce(greatest(-step, 0), 0) AS down FROM rets)",
          rec_ema("u", "g", "up", 1 / 14), rec_ema("d", "g", "down", 1 / 14), recursive=True)
    + """SELECT g.symbol, g.ts, round(CASE WHEN g.pos >= 13 THEN CASE WHEN d.y = 0 THEN 100 ELSE 100 - 100 / (1 + u.y / d.y) END END, 6) AS rsi
    FROM g JOIN u USING (symbol, pos) JOIN d USING (symbol, pos)""",
)
def rsi_14(spark, sf):
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), X.EMA_HALO).withColumns(X.change_cols(w)).withColumn("rsi", X.rsi_col(w))
    return rounded(X.owned(d, [*ID, "rsi"]))


@query(
    "macd",
    with_(BARS, RETS, rec_ema("f", "rets", "close", 2 / 13), rec_ema("s", "rets", "close", 2 / 27),
          "m AS (SELECT symbol, pos, f.y - s.y AS line FROM f JOIN s USING (symbol, pos))",
          rec_ema("g", "m", "line", 2 / 10, 25), recursive=True)
    + """SELECT r.symbol, r.ts, round(CASE WHEN r.pos >= 25 THEN m.line END, 6) AS macd,
      round(CASE WHEN r.pos >= 33 THEN g.y END, 6) AS macd_signal, round(CASE WHEN r.pos >= 33 THEN m.line - g.y END, 6) AS macd_diff
    FROM rets r JOIN m USING (symbol, pos) LEFT JOIN g USING (symbol, pos)""",
)
def macd(spark, sf):
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), X.EMA_HALO).withColumn("macd", X.macd_line(w))
    d = d.withColumn("macd_signal", X.macd_signal(w)).withColumn("macd_diff", F.col("macd") - F.col("macd_signal"))
    return rounded(X.owned(d, [*ID, "macd", "macd_signal", "macd_diff"]))


TR = """
tr AS (
  SELECT symbol, ts, pos, ret, greatest(high - low, abs(high - close + step), abs(low - close + step)) AS tr FROM rets),
tr2 AS (SELECT *, greatest(tr, tr) AS t2, CASE WHEN pos = 13 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) ELSE tr END AS v FROM tr)"""


@query(
    "atr_14",
    with_(BARS, RETS, TR, rec_ema("a", "tr2", "v", 1 / 14, 13), recursive=True)
    + """SELECT t.symbol, t.ts, round(coalesce(a.y, 0), 6) AS atr, round(t.ret / nullif(coalesce(a.y, 0), 0), 9) AS ret_atr_norm
    FROM tr2 t LEFT JOIN a USING (symbol, pos)""",
)
def atr_14(spark, sf):
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), X.EMA_HALO).withColumns(X.change_cols(w)).withColumn("atr", X.atr_col(w))
    d = d.withColumn("ret_atr_norm", F.col("ret") / F.nullif(F.col("atr"), F.lit(0.0)))
    return X.owned(d, [*ID, F.round("atr", 6).alias("atr"), (F.round("ret_atr_norm", 9) + 0.0).alias("ret_atr_norm")])


# A log of what is not positive and a quotient by zero are NULL, as everywhere in the library.
MICRO_SQL = f"""
p AS (SELECT *, CASE WHEN close > 0 AND prev > 0 THEN ln(close / prev) END AS ret, CASE WHEN high > 0 AND low > 0 THEN ln(high / low) END AS hl, CASE WHEN close > 0 AND open > 0 THEN ln(close / open) END AS co,
  nullif(high - low, 0) AS rng, nullif(volume * close, 0) AS dv FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM bars)),
q AS (SELECT *, abs(ret) / dv AS amihud, 0.5 * hl^2 - (2*ln(2)-1) * co^2 AS gk, abs(close-open)/rng AS body,
  ((close-low)-(high-close))/rng AS clv, sign(ret)*volume/nullif({full('volume', 'avg', 12)}, 0) AS sv FROM p),
l AS (SELECT symbol, ts, {full('amihud', 'avg', 12)} AS amihud_12, {full('amihud', 'avg', 36)} AS amihud_36,
  {full('gk', 'avg', 36)} AS gk_vol_36, {full('body', 'avg', 12)} AS body_frac_12, {full('clv', 'avg', 12)} AS clv_12,
  {full('clv', 'avg', 36)} AS clv_36, {full('sv', 'avg', 12)} AS signed_vol_12 FROM q)"""


@query("microstructure", with_(BARS, MICRO_SQL) + f"SELECT symbol, ts, {r(X.MICRO)} FROM l")
def microstructure(spark, sf):
    return rounded(X.microstructure(T.bars(spark, sf)).select(*ID, *X.MICRO))


HS = [*Y.HORIZONS, *Y.LONG_HORIZONS]
TARGETS = (
    "\ntg AS (SELECT b.*, "
    + ", ".join(f"ln(f{h}.close / b.close) AS r_{h}" for h in HS)
    + " FROM bars b "
    + " ".join(f"LEFT JOIN bars f{h} ON f{h}.symbol = b.symbol AND f{h}.ts = b.ts + INTERVAL {h} HOUR" for h in HS)
    + ")"
)


@query("targets_exact", with_(BARS, TARGETS) + f"SELECT symbol, ts, {r([f'r_{h}' for h in HS], 9)} FROM tg")
def targets_exact(spark, sf):
    return rounded(Y.targets(T.bars(spark, sf)).select(*ID, *[f"r_{h}" for h in HS]), 9)


@query(
    "cross_asset_return",
    with_(BARS, RETS)
    + f"SELECT r.symbol, r.ts, round(b.ret, 9) + 0.0 AS base_ret FROM rets r LEFT JOIN rets b ON b.symbol = '{T.BASE_SYMBOL}' AND b.ts = r.ts WHERE r.symbol <> '{T.BASE_SYMBOL}'",
)
def cross_asset_return(spark, sf):
    return rounded(X.cross_asset(T.bars(spark, sf), T.BASE_SYMBOL).select(*ID, "base_ret"), 9)


def _matrix_sql():
    """Everything except the recursive columns, which have their own twins."""
    plain = [c for c in X.FEATURES if c not in ("rsi", "macd", "macd_signal", "macd_diff", "atr", "ret_atr_norm")]
    lags = ", ".join(f"lag(ret, {k}) OVER w AS ret_lag_{k}, lag(volume, {k}) OVER w AS vol_lag_{k}" for k in X.LAGS)
    sql = with_(
        BARS, RETS, TARGETS, "s AS (SELECT *, sign(step) * volume AS sv FROM rets)",
        f"l AS (SELECT symbol, ts, ret * ret AS ret_sq, {lags}, {', '.join(roll_exprs())}, "
        f"4 * ({full('close', 'stddev_pop', 20)}) / ({full('close', 'avg', 20)}) AS bb_width, "
        f"({full('sv', 'sum', 36)}) / nullif({full('volume', 'sum', 36)}, 0) AS obv_roc_36, "
        "sin(2*pi()*(hour(ts)+minute(ts)/60.0)/24) AS hour_sin, cos(2*pi()*(hour(ts)+minute(ts)/60.0)/24) AS hour_cos, "
        "sin(2*pi()*(isodow(ts)-1)/7) AS dow_sin, cos(2*pi()*(isodow(ts)-1)/7) AS dow_cos "
        "FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts))",
        f"c AS (SELECT r.symbol, r.ts, CASE WHEN r.symbol <> '{T.BASE_SYMBOL}' THEN b.ret END AS base_ret FROM rets r LEFT JOIN rets b ON b.symbol = '{T.BASE_SYMBOL}' AND b.ts = r.ts)",
    )
    names = [*plain, "base_ret", *[f"r_{h}" for h in HS]]
    return plain, sql + f"SELECT l.symbol, l.ts, {r(names)} FROM l JOIN tg USING (symbol, ts) JOIN c USING (symbol, ts)"


PLAIN, MATRIX_SQL = _matrix_sql()


@query("feature_matrix", MATRIX_SQL)
def feature_matrix(spark, sf):
    """Features and targets in one pass; the recursive columns are compared in their own queries."""
    d = Y.dataset(T.candles(spark, sf), base=T.BASE_SYMBOL)
    return rounded(d.select(*ID, *PLAIN, "base_ret", *[f"r_{h}" for h in HS]))


@query("feature_matrix_full")
def feature_matrix_full(spark, sf):
    """All model inputs and targets, the recursive ones included."""
    d = Y.dataset(T.candles(spark, sf), base=T.BASE_SYMBOL)
    return d.select(*ID, *Y.feature_columns(d.columns), *[f"r_{h}" for h in HS])


@query(
    "schema_hash",
    "SELECT 'base' AS scheme, {n} AS n_features, substr(sha256('{l}'), 1, 12) AS schema_version, count(*) AS n_rows FROM (SELECT DISTINCT event_type, date_trunc('hour', ts) FROM events)".format(
        n=len(X.FEATURES), l=",".join(X.FEATURES)
    ),
)
def schema_hash(spark, sf):
    from tidemark.functions.text import schema_version

    names = Y.feature_columns(X.features(T.bars(spark, sf)).columns)
    return T.bars(spark, sf).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("base").alias("scheme"),
        F.lit(len(names)).alias("n_features"),
        schema_version(F.array(*[F.lit(c) for c in names])).alias("schema_version"),
        "n_rows",
    )


@query(
    "scaled_targets",
    with_(BARS, RETS, TARGETS, f"l AS (SELECT symbol, ts, {full('ret', 'stddev_samp', 144)} AS sd FROM rets)")
    + "SELECT symbol, ts, round(sd, 9) AS ret_std_144, "
    + ", ".join(f"round(r_{h} / nullif(sd, 0), 6) + 0.0 AS s_{h}" for h in Y.HORIZONS)
    + " FROM l JOIN tg USING (symbol, ts)",
)
def scaled_targets(spark, sf):
    d = Y.dataset(T.bars(spark, sf), horizons=Y.HORIZONS)
    sd = F.col("ret_std_144")
    return d.select(
        *ID,
        F.round(sd, 9).alias("ret_std_144"),
        *[(F.round(Y.vol_scaled(F.col(f"r_{h}"), sd), 6) + 0.0).alias(f"s_{h}") for h in Y.HORIZONS],
    )


@query(
    "regime_series",
    with_(BARS, RETS, f"l AS (SELECT symbol, ts, {full('ret', 'stddev_samp', 144)} AS vol_level, {full('ret', 'stddev_samp', 6)} AS s6 FROM rets)")
    + "SELECT symbol, ts, round(vol_level, 8) AS vol_level, round(s6 / nullif(vol_level, 0), 6) AS vol_accel FROM l",
)
def regime_series(spark, sf):
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), 145).withColumn("ret", X.ret_col(w))
    d = d.withColumns({f"ret_std_{n}": X.full(F.col("ret"), F.stddev_samp, w, n) for n in (6, 144)})
    return X.owned(
        d,
        [
            *ID,
            F.round("ret_std_144", 8).alias("vol_level"),
            F.round(F.col("ret_std_6") / F.nullif(F.col("ret_std_144"), F.lit(0.0)), 6).alias("vol_accel"),
        ],
    )
