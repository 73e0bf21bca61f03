"""Queries on folds, baselines, fold metrics, pooling and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import tables as T
from tidemark.functions import metrics as M
from tidemark.operators import bootstrap as B, evaluation as E, features as X, splits as S, targets as Y
from tidemark.operators.blocks import BLOCK_ROWS, block_window, from_micros, full, with_position
from tidemark.plans.features import TARGETS, r, rounded
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, RETS, full as sfull, with_
from tidemark.session import settle

MIN_TRAIN, TEST, PURGE = 10 * T.DAY, 5 * T.DAY, 12
HS = Y.HORIZONS
QS = (0.1, 0.5, 0.9)


def folds_sql(src="bars", min_days=10, test_days=5, purge=12, max_days=None, name="folds") -> str:
    old = f"count(*) FILTER (b.ts < f.test_start - INTERVAL {max_days} DAY)" if max_days else "0"
    return f"""
{name}_0 AS (SELECT symbol, j, t0 + INTERVAL 1 DAY * ({min_days} + {test_days} * j) AS test_start, t0 + INTERVAL 1 DAY * ({min_days} + {test_days} * (j + 1)) AS test_end
  FROM (SELECT symbol, min(ts) AS t0, max(ts) AS t1 FROM {src} GROUP BY 1), range(0, 2000) x(j) WHERE t0 + INTERVAL 1 DAY * ({min_days} + {test_days} * j) < t1),
{name}_1 AS (SELECT f.symbol, f.j, f.test_start, f.test_end, count(*) FILTER (b.ts < f.test_start) AS test_pos,
  count(*) FILTER (b.ts >= f.test_start AND b.ts < f.test_end) AS n_test, {old} AS train_pos
  FROM {name}_0 f JOIN {src} b ON b.symbol = f.symbol GROUP BY ALL),
{name} AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY j) - 1 AS fold, test_start, test_end, train_pos,
  greatest(test_pos - {purge}, 0) AS train_end_pos, test_pos, greatest(greatest(test_pos - {purge}, 0) - train_pos, 0) AS n_train, n_test
  FROM {name}_1 WHERE n_test > 0 AND greatest(test_pos - {purge}, 0) - train_pos > 0)"""


FOLDS = folds_sql()
FOLD_COLS = "symbol, fold, test_start, test_end, train_pos, train_end_pos, test_pos, n_train, n_test"


def fold_view(f):
    return f.select(
        "symbol", "fold", from_micros("test_start").alias("test_start"), from_micros("test_end").alias("test_end"),
        "train_pos", "train_end_pos", "test_pos", "n_train", "n_test",
    )


def folds_of(bars):
    return S.fold_table(bars, MIN_TRAIN, TEST, PURGE)


@query("fold_table", with_(BARS, FOLDS) + f"SELECT {FOLD_COLS} FROM folds")
def fold_table(spark, sf):
    return fold_view(folds_of(T.candles(spark, sf)))


@query("fold_table_sliding", with_(BARS, folds_sql(max_days=8)) + f"SELECT {FOLD_COLS} FROM folds")
def fold_table_sliding(spark, sf):
    return fold_view(S.fold_table(T.bars(spark, sf), MIN_TRAIN, TEST, PURGE, 8 * T.DAY))


SALES = """
sales AS (SELECT o_orderstatus AS symbol, o_orderdate AS ts, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2)"""


def sales(spark, sf):
    """Orders as a daily series per order status: years of history."""
    from tidemark.operators.blocks import micros

    return (
        T.read(spark, sf, "orders")
        .groupBy(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("ts"))
        .agg(F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"))
        .withColumn("t", micros("ts"))
    )


@query(
    "fold_table_long_history",
    with_(SALES, folds_sql("sales", 365, 30, 12, 730)) + f"SELECT {FOLD_COLS} FROM folds",
)
def fold_table_long_history(spark, sf):
    return fold_view(S.fold_table(sales(spark, sf), 365 * T.DAY, 30 * T.DAY, 12, 730 * T.DAY))


def positioned(bars):
    return with_position(bars, X.KEYS, "t", T.HOUR * BLOCK_ROWS)


@query(
    "fold_membership_counts",
    with_(BARS, RETS, FOLDS)
    + """SELECT f.symbol, f.fold, count(*) FILTER (b.pos < f.train_end_pos) AS n_train_rows, count(*) FILTER (b.ts >= f.test_start AND b.ts < f.test_end) AS n_test_rows,
      round(sum(b.close) FILTER (b.pos < f.train_end_pos), 4) AS train_close_sum
    FROM folds f JOIN rets b USING (symbol) GROUP BY 1, 2""",
)
def fold_membership_counts(spark, sf):
    bars = settle(positioned(T.candles(spark, sf)))
    folds = folds_of(bars)
    train = (
        S.with_train_slice(bars, folds)
        .groupBy("symbol", F.col("slice").alias("fold"))
        .agg(F.count(F.lit(1)).alias("n_train_rows"), F.sum("close").alias("train_close_sum"))
    )
    test = S.with_test_fold(bars, folds, MIN_TRAIN, TEST).groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n_test_rows"))
    out = test.join(train, ["symbol", "fold"], "left").fillna(0)
    out = S.running(out, ["symbol"], "fold", ["n_train_rows", "train_close_sum"])
    return rounded(out, 4)


def target_rows(spark, sf, horizons=HS):
    """Bars with targets as a written table: baselines read them for folds, train and test."""
    return settle(Y.targets(positioned(T.candles(spark, sf)), horizons))


LONG_TARGETS = "\nlt AS (" + " UNION ALL ".join(
    f"SELECT t.symbol, t.ts, p.pos, {h} AS horizon, t.r_{h} AS r FROM tg t JOIN rets p ON p.symbol = t.symbol AND p.ts = t.ts" for h in HS
) + ")"

NAIVE = """
tr AS (SELECT f.symbol, f.fold, l.horizon, count(*) FILTER (l.r < 0) AS neg, count(*) FILTER (l.r = 0) AS zero, count(*) FILTER (l.r > 0) AS pos, count(l.r) AS n_train
  FROM folds f JOIN lt l ON l.symbol = f.symbol AND l.pos < f.train_end_pos GROUP BY 1, 2, 3),
te AS (SELECT f.symbol, f.fold, f.test_start, f.test_end, l.horizon, avg(abs(l.r)) AS mae, count(l.r) AS n_test,
  count(*) FILTER (l.r < 0) AS tneg, count(*) FILTER (l.r = 0) AS tzero, count(*) FILTER (l.r > 0) AS tpos
  FROM folds f JOIN lt l ON l.symbol = f.symbol AND l.ts >= f.test_start AND l.ts < f.test_end GROUP BY 1, 2, 3, 4, 5),
naive AS (SELECT te.symbol, te.fold, te.test_start, te.test_end, te.horizon, te.mae,
  CASE WHEN neg >= zero AND neg >= pos THEN tneg WHEN zero >= pos THEN tzero ELSE tpos END / nullif(te.n_test, 0) AS directional_accuracy, tr.n_train, te.n_test
  FROM te JOIN tr USING (symbol, fold, horizon))"""


def naive(spark, sf):
    t = target_rows(spark, sf)
    return E.naive_folds(t, folds_of(t), HS, MIN_TRAIN, TEST)


@query(
    "naive_baseline",
    with_(BARS, RETS, TARGETS, FOLDS, LONG_TARGETS, NAIVE)
    + "SELECT symbol, fold, test_start, test_end, horizon, round(mae, 9) AS mae, round(directional_accuracy, 9) AS directional_accuracy, n_train, n_test FROM naive",
)
def naive_baseline(spark, sf):
    return rounded(naive(spark, sf), 9)


POOL = """sum({m} * n_test) / sum(n_test)"""


@query(
    "naive_pooled",
    with_(BARS, RETS, TARGETS, FOLDS, LONG_TARGETS, NAIVE)
    + f"""SELECT symbol, horizon, round({POOL.format(m='mae')}, 9) AS mae, round({POOL.format(m='directional_accuracy')}, 9) AS directional_accuracy,
      count(DISTINCT fold) AS n_folds, CAST(sum(n_test) AS BIGINT) AS n_test_total FROM naive WHERE n_test > 0 GROUP BY 1, 2""",
)
def naive_pooled(spark, sf):
    return rounded(E.pool(naive(spark, sf), ["mae", "directional_accuracy"], ["symbol", "horizon"]), 9)


# --- stand-in predictors: a = mean of six returns times h, b = the previous return ----------------
PRED_A = {"a": lambda h: F.col("ret_mean_6") * h}
PREDS = {"a": lambda h: F.col("ret_mean_6") * h, "b": lambda h: F.col("ret_lag_1")}
QPREDS = {
    "a": lambda h, q: F.col(f"pct_{int(q * 100)}") * F.sqrt(F.lit(float(h))),
    "b": lambda h, q: F.col(f"pct_{int(q * 100)}"),
}


def predicted(spark, sf, quantiles=False):
    """Bars with targets, the stand-in predictors' inputs and regime columns, from one set of blocks."""
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.candles(spark, sf), 145, max(HS)).withColumn("ret", X.ret_col(w))
    ret = F.col("ret")
    cols = {
        # Rounded: equal closes six bars apart must give 0, not the last bits of a sum.
        "ret_mean_6": F.round(full(ret, F.avg, w, 6), 12),
        "ret_lag_1": F.lag("ret").over(w),
        "vol_level": full(ret, F.stddev_samp, w, 144),
        "std_6": full(ret, F.stddev_samp, w, 6),
        **Y.target_cols(w, HS, T.HOUR),
    }
    if quantiles:
        for q in QS:
            cols[f"pct_{int(q * 100)}"] = full(ret, lambda c, q=q: F.percentile(c, q), w, 144)
    d = d.withColumns(cols).withColumn("vol_accel", F.col("std_6") / F.nullif(F.col("vol_level"), F.lit(0.0)))
    return d.filter("own").drop("blk", "own", "idx", "start")


def test_rows(spark, sf, quantiles=False):
    d = settle(predicted(spark, sf, quantiles))
    return S.with_test_fold(d, folds_of(d), MIN_TRAIN, TEST)


PRED_SQL = f"""
pr AS (SELECT symbol, ts, pos, round({sfull('ret', 'avg', 6)}, 12) AS ret_mean_6, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS ret_lag_1,
  {sfull('ret', 'stddev_samp', 144)} AS vol_level, {sfull('ret', 'stddev_samp', 6)} AS std_6 FROM rets)"""


def long_preds(variants={"a": "p.ret_mean_6 * {h}", "b": "p.ret_lag_1"}):
    return "\nlp AS (" + " UNION ALL ".join(
        f"SELECT f.symbol, f.fold, p.ts, '{v}' AS variant, {h} AS horizon, t.r_{h} AS a, {e.format(h=h)} AS p, p.vol_level, p.std_6 / nullif(p.vol_level, 0) AS vol_accel "
        f"FROM folds f JOIN pr p ON p.symbol = f.symbol AND p.ts >= f.test_start AND p.ts < f.test_end JOIN tg t ON t.symbol = p.symbol AND t.ts = p.ts"
        for v, e in variants.items() for h in HS
    ) + ")"


POINT = """
pf AS (SELECT symbol, fold, variant, horizon, avg(abs(a - p)) AS mae,
  avg(CASE WHEN a IS NOT NULL AND p IS NOT NULL THEN CAST(sign(a) = sign(p) AS INT) END) AS directional_accuracy,
  count(*) FILTER (a IS NOT NULL AND p IS NOT NULL) AS n_test FROM lp GROUP BY 1, 2, 3, 4)"""
PT = with_(BARS, RETS, TARGETS, FOLDS, PRED_SQL, long_preds(), POINT)


def point_folds_df(spark, sf):
    return E.stacked(test_rows(spark, sf), ["symbol", "fold"], E.point_cells(PREDS, HS))


@query(
    "point_folds",
    PT + "SELECT symbol, fold, variant, horizon, round(mae, 9) AS mae, round(directional_accuracy, 9) AS directional_accuracy, n_test FROM pf",
)
def point_folds(spark, sf):
    return rounded(point_folds_df(spark, sf), 9)


def pooled_sql(groups, src="pf", ms=("mae", "directional_accuracy")):
    return (
        f"SELECT {groups}, " + ", ".join(f"round({POOL.format(m=m)}, 9) AS {m}" for m in ms)
        + f", count(DISTINCT fold) AS n_folds, CAST(sum(n_test) AS BIGINT) AS n_test_total FROM {src} WHERE n_test > 0 GROUP BY ALL"
    )


@query("pooled_metrics", PT + pooled_sql("symbol, variant, horizon"))
def pooled_metrics(spark, sf):
    return rounded(E.pool(point_folds_df(spark, sf), ["mae", "directional_accuracy"], ["symbol", "variant", "horizon"]), 9)


@query("pooled_overall", PT + pooled_sql("symbol, variant"))
def pooled_overall(spark, sf):
    """Second-level pooling: horizons collapsed with the same weights."""
    return rounded(E.pool(point_folds_df(spark, sf), ["mae", "directional_accuracy"], ["symbol", "variant"]), 9)


@query(
    "pooled_fold_sets",
    PT
    + """, fs AS (SELECT pf.*, s.fold_set FROM pf JOIN (VALUES ('select', 0, 1), ('judge', 2, 3), ('all', 0, 3)) s(fold_set, lo, hi) ON pf.fold BETWEEN s.lo AND s.hi)
    """
    + pooled_sql("symbol, variant, fold_set", "fs"),
)
def pooled_fold_sets(spark, sf):
    sets = {"select": range(0, 2), "judge": range(2, 4), "all": range(0, 4)}
    d = S.with_fold_sets(point_folds_df(spark, sf), sets)
    return rounded(E.pool(d, ["mae", "directional_accuracy"], ["symbol", "variant", "fold_set"]), 9)


@query(
    "variant_comparison",
    PT
    + f""", g AS (SELECT symbol, horizon, variant, {POOL.format(m='mae')} AS mae, {POOL.format(m='directional_accuracy')} AS da FROM pf WHERE n_test > 0 GROUP BY ALL)
    SELECT x.symbol, x.horizon, round(x.mae, 9) AS mae_a, round(y.mae, 9) AS mae_b, round(x.da, 9) AS directional_accuracy_a, round(y.da, 9) AS directional_accuracy_b,
      round(y.mae - x.mae, 9) + 0.0 AS mae_delta, round(y.da - x.da, 9) + 0.0 AS directional_accuracy_delta
    FROM g x JOIN g y ON x.symbol = y.symbol AND x.horizon = y.horizon AND x.variant = 'a' AND y.variant = 'b'""",
)
def variant_comparison(spark, sf):
    ms = ["mae", "directional_accuracy"]
    p = E.pool(point_folds_df(spark, sf), ms, ["symbol", "variant", "horizon"])
    return rounded(E.side_by_side(p, ["symbol", "horizon"], ms, "a", "b"), 9)


@query(
    "vs_reference_level",
    PT
    + f""", g AS (SELECT symbol, variant, {POOL.format(m='mae')} AS mae FROM pf WHERE n_test > 0 GROUP BY ALL)
    SELECT g.symbol, g.variant, round(g.mae, 9) AS mae, round(g.mae - z.mae, 9) + 0.0 AS mae_delta, round((g.mae - z.mae) / z.mae, 9) + 0.0 AS mae_pct
    FROM g JOIN g z ON z.symbol = g.symbol AND z.variant = 'a'""",
)
def vs_reference_level(spark, sf):
    p = E.pool(point_folds_df(spark, sf), ["mae"], ["symbol", "variant"]).select("symbol", "variant", "mae")
    return rounded(E.versus_level(p, ["symbol"], "variant", "a", "mae"), 9)


DAILY = """
ds AS (SELECT symbol, variant, horizon, date_trunc('day', ts) AS day, count(*) AS n, sum(CAST(sign(a) = sign(p) AS INT)) AS n_dir_correct,
  sum(abs(a - p)) AS sum_abs_err, sum(abs(a)) AS sum_abs_actual FROM lp WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY ALL)"""
DSQL = with_(BARS, RETS, TARGETS, FOLDS, PRED_SQL, long_preds(), DAILY)


def daily_df(spark, sf):
    return E.daily_stats(test_rows(spark, sf), PREDS, HS)


@query(
    "daily_stats",
    DSQL + "SELECT symbol, variant, horizon, CAST(day AS TIMESTAMP) AS day, n, CAST(n_dir_correct AS BIGINT) AS n_dir_correct, round(sum_abs_err, 8) AS sum_abs_err, round(sum_abs_actual, 8) AS sum_abs_actual FROM ds",
)
def daily_stats(spark, sf):
    return rounded(daily_df(spark, sf), 8)


@query(
    "daily_rollup",
    DSQL
    + """SELECT symbol, variant, CASE WHEN grouping(horizon) = 1 THEN 'pooled' ELSE CAST(horizon AS VARCHAR) END AS horizon, CAST(sum(n) AS BIGINT) AS n,
      round(sum(n_dir_correct) / sum(n), 9) AS directional_accuracy, round(sum(sum_abs_err) / sum(n), 9) AS mae FROM ds GROUP BY GROUPING SETS ((symbol, variant, horizon), (symbol, variant))""",
)
def daily_rollup(spark, sf):
    d = daily_df(spark, sf)
    d.createOrReplaceTempView("tidemark_daily")
    return rounded(
        spark.sql(
            """SELECT symbol, variant, CASE WHEN grouping(horizon) = 1 THEN 'pooled' ELSE CAST(horizon AS STRING) END AS horizon, sum(n) AS n,
            sum(n_dir_correct) / sum(n) AS directional_accuracy, sum(sum_abs_err) / sum(n) AS mae FROM tidemark_daily
            GROUP BY GROUPING SETS ((symbol, variant, horizon), (symbol, variant))"""
        ),
        9,
    )


N_BOOT = 10_000


def _boot_sql():
    hs = ", ".join(f"('{h}', {h}, {h})" for h in HS) + f", ('pooled', {min(HS)}, {max(HS)})"
    return DSQL + f""",
dy AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS ix, count(*) OVER (PARTITION BY symbol) AS d FROM (SELECT DISTINCT symbol, day FROM ds)),
lab AS (SELECT * FROM (VALUES {hs}) v(horizon, lo, hi)),
m AS (SELECT dy.symbol, dy.ix, dy.d, lab.horizon,
  sum(CASE WHEN variant = 'a' THEN n ELSE 0 END) AS na, sum(CASE WHEN variant = 'a' THEN n_dir_correct ELSE 0 END) AS ca, sum(CASE WHEN variant = 'a' THEN sum_abs_err ELSE 0 END) AS ea,
  sum(CASE WHEN variant = 'b' THEN n ELSE 0 END) AS nb, sum(CASE WHEN variant = 'b' THEN n_dir_correct ELSE 0 END) AS cb, sum(CASE WHEN variant = 'b' THEN sum_abs_err ELSE 0 END) AS eb
  FROM dy CROSS JOIN lab LEFT JOIN ds ON ds.symbol = dy.symbol AND ds.day = dy.day AND ds.horizon BETWEEN lab.lo AND lab.hi GROUP BY ALL),
sh AS (SELECT DISTINCT symbol, d, least(7, d) AS blk, CAST(ceil(d / least(7, d)) AS BIGINT) AS nb FROM dy),
dr AS (SELECT symbol, k, slot, d, blk, (('0x' || substr(md5('0:' || k || ':' || slot), 1, 8))::BIGINT) % (d - blk + 1) AS start FROM sh, range(0, {N_BOOT}) a(k), range(0, 1000) s(slot) WHERE slot < nb),
ix AS (SELECT symbol, k, CAST(start + o AS BIGINT) AS ix FROM dr, range(0, 7) x(o) WHERE o < blk AND slot * blk + o < d),
bt AS (SELECT ix.symbol, m.horizon, ix.k, sum(cb) / sum(nb) - sum(ca) / sum(na) AS delta FROM ix JOIN m USING (symbol, ix) GROUP BY ALL),
ci AS (SELECT symbol, horizon, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi, avg(CAST(delta > 0 AS INT)) AS gt FROM bt GROUP BY ALL),
tt AS (SELECT symbol, horizon, d AS n_days, sum(ca) / sum(na) AS da_a, sum(cb) / sum(nb) AS da_b, sum(ea) / sum(na) AS mae_a, sum(eb) / sum(nb) AS mae_b FROM m GROUP BY ALL)
SELECT symbol, horizon, n_days, round(da_a, 9) AS da_a, round(da_b, 9) AS da_b, round((da_b - da_a) * 100, 7) + 0.0 AS delta_da_pp, round(lo * 100, 7) + 0.0 AS ci_lo_pp, round(hi * 100, 7) + 0.0 AS ci_hi_pp,
  round(gt, 9) AS p_delta_gt_0, round(mae_a, 9) AS mae_a, round(mae_b, 9) AS mae_b, round((mae_b - mae_a) / mae_a * 100, 7) + 0.0 AS delta_mae_pct FROM tt JOIN ci USING (symbol, horizon)"""


@query("bootstrap_delta", _boot_sql())
def bootstrap_delta(spark, sf):
    d = B.block_bootstrap(daily_df(spark, sf), "a", "b", HS, 7, N_BOOT, 0)
    return d.select(
        "symbol", "horizon", "n_days",
        *[(F.round(c, n) + 0.0).alias(c) for c, n in (
            ("da_a", 9), ("da_b", 9), ("delta_da_pp", 7), ("ci_lo_pp", 7), ("ci_hi_pp", 7), ("p_delta_gt_0", 9),
            ("mae_a", 9), ("mae_b", 9), ("delta_mae_pct", 7))],
    )


# --- regimes ------------------------------------------------------------------------------------
def _regime_sql(tail):
    parts = []
    for ax in ("vol_level", "vol_accel"):
        x = "p.vol_level" if ax == "vol_level" else "p.std_6 / nullif(p.vol_level, 0)"
        parts.append(
            f"""
e_{ax} AS (SELECT f.symbol, f.fold, quantile_cont({x}, 1.0/3) AS e1, quantile_cont({x}, 2.0/3) AS e2 FROM folds f JOIN pr p ON p.symbol = f.symbol AND p.pos < f.train_end_pos GROUP BY 1, 2)"""
        )
    un = " UNION ALL ".join(
        f"SELECT l.symbol, l.fold, '{ax}' AS axis, l.horizon, CASE WHEN l.{ax} >= e2 THEN 'hi' WHEN l.{ax} >= e1 THEN 'mid' ELSE 'lo' END AS bucket, a, p FROM lp l JOIN e_{ax} USING (symbol, fold) WHERE l.{ax} IS NOT NULL AND e1 IS NOT NULL"
        for ax in ("vol_level", "vol_accel")
    )
    return with_(
        BARS, RETS, TARGETS, FOLDS, PRED_SQL, long_preds({"a": "p.ret_mean_6 * {h}"}), *parts, f"\nru AS ({un})",
        """
rf AS (SELECT symbol, fold, axis, horizon, bucket, count(*) AS n, sum(CAST(sign(a) = sign(p) AS INT)) AS n_dir_correct, sum(abs(a - p)) AS sum_abs_err, sum(abs(a)) AS sum_abs_actual
  FROM ru WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY ALL),
rp AS (SELECT symbol, axis, horizon, bucket, sum(n) AS n, count(DISTINCT fold) AS n_folds, sum(sum_abs_err) / sum(n) AS mae_model, sum(sum_abs_actual) / sum(n) AS mae_naive, sum(n_dir_correct) / sum(n) AS dir_acc FROM rf GROUP BY ALL)""",
    ) + tail


def regime_rows(spark, sf):
    d = settle(predicted(spark, sf))
    folds = folds_of(d)
    te = S.with_test_fold(d, folds, MIN_TRAIN, TEST)
    out = None
    for ax in ("vol_level", "vol_accel"):
        part = E.regime_folds(te, E.regime_edges(d, folds, ax), ax, PREDS["a"], HS)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "regime_table",
    _regime_sql(
        "SELECT symbol, axis, horizon, bucket, CAST(n AS BIGINT) AS n, n_folds, round(mae_model, 8) AS mae_model, round(mae_naive, 8) AS mae_naive, round(dir_acc, 8) AS dir_acc, round(1 - mae_model / mae_naive, 7) + 0.0 AS skill FROM rp"
    ),
)
def regime_table(spark, sf):
    d = E.regime_pooled(regime_rows(spark, sf), ["symbol", "axis", "horizon", "bucket"])
    return d.select(
        "symbol", "axis", "horizon", "bucket", "n", "n_folds", F.round("mae_model", 8).alias("mae_model"),
        F.round("mae_naive", 8).alias("mae_naive"), F.round("dir_acc", 8).alias("dir_acc"), (F.round("skill", 7) + 0.0).alias("skill"),
    )


@query(
    "regime_pivot",
    _regime_sql(
        """, g AS (SELECT *, 1 - mae_model / mae_naive AS skill FROM rp)
    SELECT symbol, axis, horizon, """
        + ", ".join(
            f"round(max(CASE WHEN bucket = '{b}' THEN {m} END), 7) + 0.0 AS {b}_{n}" for b in ("lo", "mid", "hi") for m, n in (("skill", "skill"), ("dir_acc", "da"))
        )
        + ", round(max(CASE WHEN bucket = 'hi' THEN skill END) - max(CASE WHEN bucket = 'lo' THEN skill END), 7) + 0.0 AS skill_hi_minus_lo"
        + ", round(max(CASE WHEN bucket = 'hi' THEN dir_acc END) - max(CASE WHEN bucket = 'lo' THEN dir_acc END), 7) + 0.0 AS da_hi_minus_lo FROM g GROUP BY 1, 2, 3"
    ),
)
def regime_pivot(spark, sf):
    return rounded(E.regime_pivot(E.regime_pooled(regime_rows(spark, sf), ["symbol", "axis", "horizon", "bucket"])), 7)


# --- quantile forecasts --------------------------------------------------------------------------
QP = "\nqp AS (SELECT symbol, ts, " + ", ".join(sfull("ret", "Q", 144).replace("Q(ret)", f"quantile_cont(ret, {q})") + f" AS pct_{int(q * 100)}" for q in QS) + " FROM rets)"
QLONG = "\nql AS (" + " UNION ALL ".join(
    f"SELECT f.symbol, f.fold, '{v}' AS variant, {h} AS horizon, {q} AS quantile, t.r_{h} AS a, p.pct_{int(q * 100)} * {'sqrt(%d)' % h if v == 'a' else '1'} AS p "
    f"FROM folds f JOIN qp p ON p.symbol = f.symbol AND p.ts >= f.test_start AND p.ts < f.test_end JOIN tg t ON t.symbol = p.symbol AND t.ts = p.ts"
    for v in "ab" for h in HS for q in QS
) + ")"
QF = """
qf AS (SELECT symbol, fold, variant, horizon, CAST(quantile AS DOUBLE) AS quantile, avg(greatest(quantile * (a - p), (quantile - 1) * (a - p))) AS pinball_loss,
  avg(CAST(a <= p AS INT)) AS coverage, count(*) FILTER (a IS NOT NULL AND p IS NOT NULL) AS n_test FROM ql GROUP BY ALL)"""
QSQL = with_(BARS, RETS, TARGETS, FOLDS, QP, QLONG, QF)


def quantile_folds_df(spark, sf):
    return E.stacked(test_rows(spark, sf, True), ["symbol", "fold"], E.quantile_cells(QPREDS, HS, QS))


@query(
    "quantile_folds",
    QSQL + "SELECT symbol, fold, variant, horizon, quantile, round(pinball_loss, 9) AS pinball_loss, round(coverage, 9) AS coverage, n_test FROM qf",
)
def quantile_folds(spark, sf):
    return rounded(quantile_folds_df(spark, sf), 9)


@query("quantile_pooled", QSQL + pooled_sql("symbol, variant, horizon, quantile", "qf", ("pinball_loss", "coverage")))
def quantile_pooled(spark, sf):
    d = E.pool(quantile_folds_df(spark, sf), ["pinball_loss", "coverage"], ["symbol", "variant", "horizon", "quantile"])
    return rounded(d, 9)


@query(
    "fold_pinball",
    QSQL + "SELECT symbol, variant, fold, round(sum(pinball_loss * n_test) / sum(n_test), 9) AS overall_pinball_loss FROM qf GROUP BY 1, 2, 3",
)
def fold_pinball(spark, sf):
    return rounded(E.fold_overall(quantile_folds_df(spark, sf)), 9)


@query(
    "coverage_calibration",
    QSQL
    + """, g AS (SELECT symbol, variant, quantile, fold, sum(coverage * n_test) / sum(n_test) AS c FROM qf WHERE quantile IN (0.1, 0.9) GROUP BY ALL)
    SELECT symbol, variant, quantile, count(*) AS n_folds, count(*) FILTER (abs(c - quantile) <= 0.03) AS folds_within_tolerance, round(avg(c), 9) AS mean_coverage FROM g GROUP BY 1, 2, 3""",
)
def coverage_calibration(spark, sf):
    return rounded(E.coverage_calibration(quantile_folds_df(spark, sf)), 9)


# --- further fold queries --------------------------------------------------------------------------
@query(
    "naive_within_folds",
    with_(BARS, RETS, TARGETS, FOLDS, LONG_TARGETS, NAIVE, folds_sql(min_days=10, test_days=10, name="big"), PRED_SQL,
          long_preds({"a": "p.ret_mean_6 * {h}"}).replace("FROM folds f", "FROM big f").replace("SELECT f.symbol, f.fold,", "SELECT f.symbol, f.fold, f.test_start, f.test_end,"),
          """
md AS (SELECT symbol, fold, test_start, test_end, horizon, avg(abs(a - p)) AS mae, avg(CASE WHEN a IS NOT NULL AND p IS NOT NULL THEN CAST(sign(a) = sign(p) AS INT) END) AS directional_accuracy,
  count(*) FILTER (a IS NOT NULL AND p IS NOT NULL) AS n_test FROM lp GROUP BY ALL)""")
    + """SELECT m.symbol, m.fold, m.horizon, m.test_start, m.n_test, round(m.mae, 9) AS mae, round(m.directional_accuracy, 9) AS directional_accuracy,
      round(sum(w.mae * w.n_test) / sum(w.n_test), 9) AS naive_mae, round(sum(w.directional_accuracy * w.n_test) / sum(w.n_test), 9) AS naive_da, count(*) AS n_weekly
    FROM md m JOIN naive w ON w.symbol = m.symbol AND w.horizon = m.horizon AND w.test_start >= m.test_start AND w.test_start < m.test_end GROUP BY ALL""",
)
def naive_within_folds(spark, sf):
    """Ten-day model folds next to the five-day naive folds that start inside them."""
    bars = T.bars(spark, sf)
    big = S.fold_table(bars, MIN_TRAIN, 2 * TEST, PURGE)
    te = S.with_test_fold(predicted(spark, sf), big, MIN_TRAIN, 2 * TEST)
    model = E.stacked(te, ["symbol", "fold", "test_start", "test_end"], E.point_cells(PRED_A, HS))
    model = model.withColumns({c: from_micros(c) for c in ("test_start", "test_end")})
    return rounded(E.naive_within_folds(model, naive(spark, sf)), 9)


@query(
    "recency_weights",
    with_(BARS, RETS, FOLDS)
    + """SELECT f.symbol, f.fold, count(*) AS n_rows, round(sum(exp(-ln(2) / 5 * epoch(f.test_start - b.ts) / 86400)), 6) AS weight_sum,
      round(sum(b.ret * exp(-ln(2) / 5 * epoch(f.test_start - b.ts) / 86400)) / sum(CASE WHEN b.ret IS NOT NULL THEN exp(-ln(2) / 5 * epoch(f.test_start - b.ts) / 86400) END), 9) + 0.0 AS weighted_ret
    FROM folds f JOIN rets b ON b.symbol = f.symbol AND b.pos < f.train_end_pos GROUP BY 1, 2""",
)
def recency_weights(spark, sf):
    """Weighted mean return per fold, half-life five days, the age counted from the fold's start."""
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), 1).withColumn("ret", X.ret_col(w)).filter("own")
    sums = {"weight_sum": F.sum("wt"), "x": F.sum(F.col("ret") * F.col("wt")), "w": F.sum(F.when(F.col("ret").isNotNull(), F.col("wt")))}
    d = S.recency_sums(d.select("symbol", "t", "pos", "ret"), folds_of(T.bars(spark, sf)), 5.0, sums)
    return d.select("symbol", "fold", "n_rows", F.round("weight_sum", 6).alias("weight_sum"), (F.round(F.col("x") / F.col("w"), 9) + 0.0).alias("weighted_ret"))


@query(
    "holdout_split",
    with_(BARS)
    + """SELECT symbol, part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, CASE WHEN ts < max(ts) OVER (PARTITION BY symbol) - INTERVAL 7 DAY THEN 'train' ELSE 'holdout' END AS part FROM bars) GROUP BY 1, 2""",
)
def holdout_split(spark, sf):
    d = S.holdout(T.bars(spark, sf), 7.0)
    return d.groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


HOLD = """
hd AS (SELECT *, ts < max(ts) OVER (PARTITION BY symbol) - INTERVAL 7 DAY AS is_train FROM tg)"""


@query(
    "constant_quantile_pinball",
    with_(BARS, TARGETS, HOLD,
          "\nhl AS (" + " UNION ALL ".join(f"SELECT symbol, is_train, {h} AS horizon, r_{h} AS r FROM hd" for h in HS) + ")",
          """
cq AS (SELECT symbol, horizon, q, CASE WHEN q = 0.1 THEN q1 ELSE q2 END AS c FROM (SELECT symbol, horizon, quantile_cont(r, 0.1) AS q1, quantile_cont(r, 0.9) AS q2 FROM hl WHERE is_train GROUP BY 1, 2), (VALUES (0.1), (0.9)) v(q))""")
    + """SELECT h.symbol, h.horizon, CAST(cq.q AS DOUBLE) AS quantile, round(any_value(cq.c), 9) + 0.0 AS constant, round(avg(greatest(cq.q * (h.r - cq.c), (cq.q - 1) * (h.r - cq.c))), 9) AS pinball_loss, count(h.r) AS n
    FROM hl h JOIN cq ON cq.symbol = h.symbol AND cq.horizon = h.horizon WHERE NOT h.is_train GROUP BY 1, 2, 3""",
)
def constant_quantile_pinball(spark, sf):
    """Holdout loss of "always the train quantile", per horizon and level."""
    from tidemark.operators.screens import constant_quantiles

    return rounded(constant_quantiles(S.holdout(target_rows(spark, sf), 7.0), HS, (0.1, 0.9)), 9)


@query(
    "naive_point_baseline",
    with_(BARS, TARGETS, HOLD,
          "\nhl AS (" + " UNION ALL ".join(f"SELECT symbol, is_train, {h} AS horizon, r_{h} AS r FROM hd" for h in HS) + ")",
          """
g AS (SELECT symbol, horizon, count(*) FILTER (is_train AND r < 0) AS neg, count(*) FILTER (is_train AND r = 0) AS zero, count(*) FILTER (is_train AND r > 0) AS pos,
  count(*) FILTER (NOT is_train AND r < 0) AS tneg, count(*) FILTER (NOT is_train AND r = 0) AS tzero, count(*) FILTER (NOT is_train AND r > 0) AS tpos, avg(abs(r)) FILTER (NOT is_train) AS mae, count(r) FILTER (NOT is_train) AS n FROM hl GROUP BY 1, 2)""")
    + """SELECT symbol, round(avg(mae), 9) AS avg_mae, round(avg(CASE WHEN neg >= zero AND neg >= pos THEN tneg WHEN zero >= pos THEN tzero ELSE tpos END / n), 9) AS avg_dir_acc, count(*) AS n_horizons FROM g WHERE n > 0 GROUP BY 1""",
)
def naive_point_baseline(spark, sf):
    from tidemark.operators.screens import naive_point

    return rounded(naive_point(S.holdout(target_rows(spark, sf), 7.0), HS), 9)


HELD_OUT = with_(
    BARS, RETS, TARGETS, PRED_SQL, QP, HOLD,
    "\nhe AS (" + " UNION ALL ".join(f"SELECT t.symbol, {h} AS horizon, t.r_{h} AS a, p.ret_mean_6 * {h} AS p, q.pct_10 * sqrt({h}) AS q10, q.pct_90 * sqrt({h}) AS q90 FROM hd t JOIN pr p USING (symbol, ts) JOIN qp q USING (symbol, ts) WHERE NOT is_train" for h in HS) + ")",
)


def holdout_cells(spark, sf):
    """Scores of every symbol and horizon with held-out rows."""
    d = S.last_days(predicted(spark, sf, True), 7.0)
    cells = []
    for h in HS:
        a, p = F.col(f"r_{h}"), PREDS["a"](h)
        q10, q90 = QPREDS["a"](h, 0.1), QPREDS["a"](h, 0.9)
        cells.append(({"horizon": h}, {
            "n": F.count(a), "mae": M.mae(a, p), "directional_accuracy": M.directional_accuracy(a, p),
            "pinball_10": M.pinball(a, q10, 0.1), "pinball_90": M.pinball(a, q90, 0.9),
            "coverage_10": M.coverage(a, q10), "coverage_90": M.coverage(a, q90),
        }))
    return E.stacked(d, ["symbol"], cells).filter("n > 0")


@query(
    "holdout_eval",
    HELD_OUT
    + """SELECT symbol, horizon, count(a) AS n, round(avg(abs(a - p)), 9) AS mae, round(avg(CASE WHEN a IS NOT NULL AND p IS NOT NULL THEN CAST(sign(a) = sign(p) AS INT) END), 9) AS directional_accuracy,
      round(avg(greatest(0.1 * (a - q10), -0.9 * (a - q10))), 9) AS pinball_10, round(avg(greatest(0.9 * (a - q90), -0.1 * (a - q90))), 9) AS pinball_90,
      round(avg(CAST(a <= q10 AS INT)), 9) AS coverage_10, round(avg(CAST(a <= q90 AS INT)), 9) AS coverage_90,
      abs(avg(CAST(a <= q10 AS INT)) - 0.1) <= 0.03 AS within_10, abs(avg(CAST(a <= q90 AS INT)) - 0.9) <= 0.03 AS within_90
    FROM he GROUP BY 1, 2 HAVING count(a) > 0""",
)
def holdout_eval(spark, sf):
    """Point and corridor scores of the last seven days, per symbol and horizon."""
    out = holdout_cells(spark, sf)
    out = out.withColumns(
        {
            "within_10": F.abs(F.col("coverage_10") - 0.1) <= 0.03,
            "within_90": F.abs(F.col("coverage_90") - 0.9) <= 0.03,
        }
    )
    return rounded(out, 9)


@query(
    "holdout_corridor",
    HELD_OUT
    + """, cell AS (SELECT symbol, horizon, avg(greatest(0.1 * (a - q10), -0.9 * (a - q10))) AS pinball, coalesce(abs(avg(CAST(a <= q10 AS INT)) - 0.1) <= 0.03, false) AS within FROM he GROUP BY 1, 2 HAVING count(a) > 0
      UNION ALL SELECT symbol, horizon, avg(greatest(0.9 * (a - q90), -0.1 * (a - q90))), coalesce(abs(avg(CAST(a <= q90 AS INT)) - 0.9) <= 0.03, false) FROM he GROUP BY 1, 2 HAVING count(a) > 0)
    SELECT symbol, count(*) AS n_cells, count(*) FILTER (within) AS n_within, round(avg(pinball), 9) AS avg_pinball, count(*) FILTER (within) * 2 > count(*) AS majority_calibrated FROM cell GROUP BY 1""",
)
def holdout_corridor(spark, sf):
    """Is the corridor calibrated on most horizons of the last seven days, per symbol?"""
    return rounded(E.corridor_summary(holdout_cells(spark, sf), ["symbol"]), 9)
