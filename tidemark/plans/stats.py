"""Queries on screens, regressions, rank tests and parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import tables as T
from tidemark.functions import metrics as M
from tidemark.operators import (
    evaluation as E, features as X, funding as FU, grid as G, news as N, screens as SC, splits as S, stats as ST, targets as Y,
)
from tidemark.operators.blocks import BLOCK_ROWS, block_window, full, with_position
from tidemark.plans import evaluation as PE, joins as PJ
from tidemark.plans.features import RETS, TARGETS, rounded
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, full as sfull, with_, chi2_upper, t_quantile, t_two_sided
from tidemark.session import settle

HAC_LAG = 96


def r_(expr, name, d=9):
    return f"round({expr}, {d}) + 0.0 AS {name}"


# --- funding screen --------------------------------------------------------------------------------
def panel(spark, sf):
    """Bars with their newest funding z and the forward returns."""
    t = Y.targets(T.bars(spark, sf), (6, 12)).select("symbol", "t", "ts", "r_6", "r_12")
    d = FU.attach_funding(t, T.funding(spark, sf), PJ.ZW, PJ.ZMIN)
    return settle(d.withColumns({"abs_r_12": F.abs("r_12"), "abs_r_6": F.abs("r_6")}))


PANEL = PJ.FASOF + """,
pn AS (SELECT fa.symbol, fa.ts, fa.f_rate, fa.f_z, abs(fa.f_z) AS f_absz, t.r_6, t.r_12 FROM fa JOIN tg t USING (symbol, ts))"""
PSQL = with_(BARS, TARGETS, PJ.FUNDING, PANEL)


@query(
    "ols_hac",
    PSQL
    + f""", q AS (SELECT symbol, f_z AS x, r_6 AS y, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM pn WHERE f_z IS NOT NULL AND r_6 IS NOT NULL),
    m AS (SELECT symbol, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM q GROUP BY 1),
    u AS (SELECT q.symbol, i, x, y - my - b * (x - mx) AS e FROM q JOIN m USING (symbol)),
    g AS (SELECT a.symbol, sum(w * (2 * a.e * c.e)) AS g00, sum(w * (a.e * c.x * c.e + a.x * a.e * c.e)) AS g01, sum(w * 2 * a.x * a.e * c.x * c.e) AS g11
      FROM (SELECT *, 0 AS z FROM u) a JOIN (SELECT u.*, l, 1 - l / {HAC_LAG + 1}.0 AS w FROM u, range(1, {HAC_LAG + 1}) k(l)) c ON c.symbol = a.symbol AND c.i + c.l = a.i GROUP BY 1),
    s AS (SELECT u.symbol, sum(e * e) AS s00, sum(x * e * e) AS s01, sum(x * x * e * e) AS s11 FROM u GROUP BY 1)
    SELECT symbol, {r_('b', 'slope', 7)}, {r_('b / sqrt((mx * mx * (s00 + g00) - 2 * mx * (s01 + g01) + s11 + g11) / sxx / sxx)', 't_hac', 6)}, {r_('1 - s00 / syy', 'r2', 7)}, n FROM m JOIN g USING (symbol) JOIN s USING (symbol)""",
)
def ols_hac(spark, sf):
    d = ST.ols_hac(panel(spark, sf), ["symbol"], "t", "f_z", "r_6", HAC_LAG, T.HOUR * BLOCK_ROWS)
    return d.select(
        "symbol", (F.round("slope", 7) + 0.0).alias("slope"), (F.round("t_hac", 6) + 0.0).alias("t_hac"),
        (F.round("r2", 7) + 0.0).alias("r2"), "n",
    )


FIT = """count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(x, y) AS r,
  sqrt((1 - corr(x, y)^2) * regr_syy(y, x) / regr_sxx(y, x) / (count(*) - 2)) AS stderr"""
FIT_OUT = ", ".join(r_(c, c, 7) for c in ("slope", "intercept", "r", "stderr")) + ", " + r_("slope / stderr", "t", 6) + ", n"


def fit_out(d, *keys):
    return d.select(
        *keys, *[(F.round(c, 7) + 0.0).alias(c) for c in ("slope", "intercept", "r", "stderr")],
        (F.round("t", 6) + 0.0).alias("t"), "n",
    )


PERSQL = with_(BARS, TARGETS, PJ.FUNDING, PJ.PER)


@query(
    "linregress",
    PERSQL + f", q AS (SELECT symbol, {FIT} FROM (SELECT symbol, f_z AS x, r_6 AS y FROM per) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1) SELECT symbol, {FIT_OUT} FROM q",
)
def linregress(spark, sf):
    return fit_out(ST.linear_fit(PJ.settlements(spark, sf), ["symbol"], "f_z", "r_6"), "symbol")


@query(
    "linregress_p",
    PERSQL
    + f", q AS (SELECT symbol, {FIT} FROM (SELECT symbol, f_z AS x, r_6 AS y FROM per) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1) SELECT symbol, {FIT_OUT}, {r_(t_two_sided('slope / stderr', 'n - 2'), 'p_value', 8)} FROM q",
)
def linregress_p(spark, sf):
    """Slope test with its p-value."""
    d = ST.with_t_p(ST.linear_fit(PJ.settlements(spark, sf), ["symbol"], "f_z", "r_6"))
    return fit_out(d, "symbol", (F.round("p_value", 8) + 0.0).alias("p_value"))


RANKS = """
rk AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS ry FROM q)"""


@query(
    "spearman",
    PERSQL
    + f", q AS (SELECT symbol, f_z AS x, r_6 AS y FROM per WHERE f_z IS NOT NULL AND r_6 IS NOT NULL), {RANKS}, c AS (SELECT symbol, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY 1) SELECT symbol, n, {r_('rho', 'rho', 8)}, {r_('rho * sqrt((n - 2) / (1 - rho * rho))', 't', 6)} FROM c",
)
def spearman(spark, sf):
    d = ST.spearman(PJ.settlements(spark, sf), ["symbol"], "f_z", "r_6")
    return d.select("symbol", "n", (F.round("rho", 8) + 0.0).alias("rho"), (F.round("t", 6) + 0.0).alias("t"))


@query(
    "spearman_events",
    """WITH q AS (SELECT event_type AS symbol, value AS x, CAST(user_id AS DOUBLE) AS y FROM events), """
    + RANKS
    + f" SELECT symbol, count(*) AS n, {r_('corr(rx, ry)', 'rho', 8)} FROM rk GROUP BY 1",
)
def spearman_events(spark, sf):
    """Many tied values on both sides, one row per event."""
    d = T.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), "value", "user_id")
    return ST.spearman(d, ["symbol"], "value", "user_id").select("symbol", "n", (F.round("rho", 8) + 0.0).alias("rho"))


QCUT4 = """
e4 AS (SELECT symbol, list_sort(list_distinct([min(f_absz), quantile_cont(f_absz, 0.25), quantile_cont(f_absz, 0.5), quantile_cont(f_absz, 0.75), max(f_absz)])) AS e FROM pn WHERE f_absz IS NOT NULL AND r_12 IS NOT NULL GROUP BY 1),
b4 AS (SELECT p.symbol, abs(r_12) AS v, greatest(len(list_filter(e, lambda z: z < f_absz)) - 1, 0) AS bucket FROM pn p JOIN e4 USING (symbol) WHERE f_absz IS NOT NULL AND r_12 IS NOT NULL)"""


@query(
    "bucket_table",
    PSQL + f", {QCUT4} SELECT symbol, CAST(bucket AS INT) AS bucket, count(*) AS n, {r_('avg(v)', 'mean', 8)}, {r_('stddev_samp(v)', 'std', 8)} FROM b4 GROUP BY 1, 2",
)
def bucket_table(spark, sf):
    return rounded(SC.bucket_table(panel(spark, sf), ["symbol"], "abs_r_12", "f_absz", 4), 8)


@query(
    "bucket_spread",
    PSQL
    + f""", e5 AS (SELECT symbol, list_sort(list_distinct([min(f_z), quantile_cont(f_z, 0.2), quantile_cont(f_z, 0.4), quantile_cont(f_z, 0.6), quantile_cont(f_z, 0.8), max(f_z)])) AS e FROM pn WHERE f_z IS NOT NULL AND r_6 IS NOT NULL GROUP BY 1),
    b5 AS (SELECT p.symbol, greatest(len(list_filter(e, lambda z: z < f_z)) - 1, 0) AS bucket, avg(r_6) AS mean FROM pn p JOIN e5 USING (symbol) WHERE f_z IS NOT NULL AND r_6 IS NOT NULL GROUP BY 1, 2)
    SELECT symbol, {r_('(arg_max(mean, bucket) - arg_min(mean, bucket)) * 1e4', 'spread_bps', 4)}, count(*) AS n_buckets FROM b5 GROUP BY 1""",
)
def bucket_spread(spark, sf):
    t = SC.bucket_table(panel(spark, sf), ["symbol"], "r_6", "f_z", 5)
    return rounded(SC.bucket_spread(t, ["symbol"]), 4)


KW = """
kr AS (SELECT symbol, v, g, rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2.0 AS rk FROM kin),
kg AS (SELECT symbol, g, sum(rk) AS rs, count(*) AS ng FROM kr GROUP BY 1, 2),
kt AS (SELECT symbol, sum(c) AS n, sum(CAST(c AS DOUBLE)^3 - c) AS ties FROM (SELECT symbol, v, count(*) AS c FROM kin GROUP BY 1, 2) GROUP BY 1)"""


KRUSKAL = (
    PSQL
    + f", {QCUT4}, kin AS (SELECT symbol, v, bucket AS g FROM b4), {KW} SELECT kg.symbol, {r_('(12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / ng) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (CAST(any_value(n) AS DOUBLE)^3 - any_value(n)))', 'h', 6)}, count(*) - 1 AS dof, CAST(any_value(n) AS BIGINT) AS n FROM kg JOIN kt ON kt.symbol = kg.symbol GROUP BY 1"
)


@query("kruskal", KRUSKAL)
def kruskal(spark, sf):
    d = panel(spark, sf).filter("abs_r_12 is not null and f_absz is not null")
    return rounded(ST.kruskal(SC.bucketed(d, ["symbol"], "f_absz", 4), ["symbol"], "abs_r_12", "bucket"))


@query("kruskal_p", f"SELECT *, {r_(chi2_upper('h', 'dof'), 'p_value', 6)} FROM ({KRUSKAL})")
def kruskal_p(spark, sf):
    """The same with the chi-square tail of the rounded statistic."""
    d = panel(spark, sf).filter("abs_r_12 is not null and f_absz is not null")
    return rounded(ST.with_chi2_p(rounded(ST.kruskal(SC.bucketed(d, ["symbol"], "f_absz", 4), ["symbol"], "abs_r_12", "bucket"))))


@query(
    "kruskal_events",
    "WITH kin AS (SELECT event_type AS symbol, value AS v, user_id % 7 AS g FROM events), "
    + KW
    + f" SELECT kg.symbol, {r_('(12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / ng) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (CAST(any_value(n) AS DOUBLE)^3 - any_value(n)))', 'h', 6)}, count(*) - 1 AS dof, CAST(any_value(n) AS BIGINT) AS n FROM kg JOIN kt ON kt.symbol = kg.symbol GROUP BY 1",
)
def kruskal_events(spark, sf):
    """Event values by user cohort, with ties."""
    d = T.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), "value", (F.col("user_id") % 7).alias("g"))
    return rounded(ST.kruskal(d, ["symbol"], "value", "g"))


@query(
    "funding_coverage",
    PSQL
    + f"SELECT symbol, count(*) AS n, {r_('avg(CAST(f_z IS NOT NULL AS INT))', 'coverage')}, {r_('min(f_z)', 'min_value', 6)}, {r_('max(f_z)', 'max_value', 6)}, {r_('median(f_z)', 'median_value', 6)} FROM pn GROUP BY 1",
)
def funding_coverage(spark, sf):
    d = ST.coverage_summary(panel(spark, sf), ["symbol"], "f_z")
    return d.select(
        "symbol", "n", (F.round("coverage", 9) + 0.0).alias("coverage"),
        *[(F.round(c, 6) + 0.0).alias(c) for c in ("min_value", "max_value", "median_value")],
    )


@query(
    "all_present_ratio",
    PSQL + f"SELECT symbol, {r_('avg(CASE WHEN f_rate IS NOT NULL AND f_z IS NOT NULL THEN 1 ELSE 0 END)', 'coverage')} FROM pn GROUP BY 1",
)
def all_present_ratio(spark, sf):
    ok = F.when(F.col("f_rate").isNotNull() & F.col("f_z").isNotNull(), 1).otherwise(0)
    return panel(spark, sf).groupBy("symbol").agg(F.round(F.avg(ok), 9).alias("coverage"))


# --- order-flow screen on a non-overlapping sample ---------------------------------------------------
NON = """
no AS (SELECT t.symbol, t.ts, o.ofi_vol_lag1 AS x, t.r_6 AS y, row_number() OVER (PARTITION BY t.symbol ORDER BY t.ts) - 1 AS i FROM tg t JOIN of o USING (symbol, ts) WHERE o.ofi_vol_lag1 IS NOT NULL)"""


@query(
    "nonoverlap_regress",
    with_(BARS, TARGETS, PJ.OFI, PJ.OFIR, PJ.OFIF, NON)
    + f", q AS (SELECT symbol, {FIT} FROM no WHERE i % 6 = 0 AND x IS NOT NULL AND y IS NOT NULL GROUP BY 1) SELECT symbol, {FIT_OUT} FROM q",
)
def nonoverlap_regress(spark, sf):
    """Every sixth bar with order flow, so that six-bar returns do not overlap."""
    o = X.ofi_features(PJ.O.ofi_bars(T.trades(spark, sf))).select("symbol", "t", "ofi_vol_lag1")
    d = Y.targets(T.bars(spark, sf), (6,)).join(o, ["symbol", "t"]).filter("ofi_vol_lag1 is not null")
    d = with_position(d.select("symbol", "t", "ofi_vol_lag1", "r_6"), ["symbol"], "t", T.HOUR * BLOCK_ROWS)
    return fit_out(ST.linear_fit(d.filter(F.col("pos") % 6 == 0), ["symbol"], "ofi_vol_lag1", "r_6"), "symbol")


# --- news screens -----------------------------------------------------------------------------------
def category_rows(spark, sf):
    t = Y.targets(PE.positioned(T.bars(spark, sf)), (3, 12))
    return t.join(PJ.recent(spark, sf), ["symbol", "t"]).withColumn("abs_r_12", F.abs("r_12"))


CATSQL = with_(BARS, RETS, TARGETS, PJ.NEWS, PJ.RECENT, "\nct AS (SELECT t.symbol, t.ts, p.pos, rc.recent_category, t.r_3, abs(t.r_12) AS abs_r_12 FROM tg t JOIN rc USING (symbol, ts) JOIN rets p USING (symbol, ts))", PE.FOLDS)


@query(
    "category_table",
    CATSQL + f"SELECT symbol, recent_category, count(*) AS n, {r_('avg(abs_r_12)', 'mean', 8)}, {r_('stddev_samp(abs_r_12)', 'std', 8)}, count(*) >= 30 AS testable FROM ct WHERE abs_r_12 IS NOT NULL GROUP BY 1, 2",
)
def category_table(spark, sf):
    return rounded(SC.category_table(category_rows(spark, sf), ["symbol"], "abs_r_12", "recent_category", 30), 8)


MARG = """
mtr AS (SELECT f.symbol, f.fold, recent_category AS c, count(*) FILTER (r_3 > 0) AS up, count(*) FILTER (r_3 < 0) AS down, count(*) AS n FROM folds f JOIN ct ON ct.symbol = f.symbol AND ct.pos < f.train_end_pos WHERE r_3 IS NOT NULL GROUP BY 1, 2, 3),
mall AS (SELECT symbol, fold, sum(up) AS aup, sum(down) AS adown, sum(n) AS an FROM mtr GROUP BY 1, 2),
mte AS (SELECT f.symbol, f.fold, recent_category AS c, count(*) FILTER (r_3 > 0) AS tup, count(*) FILTER (r_3 < 0) AS tdown, count(*) AS tn FROM folds f JOIN ct ON ct.symbol = f.symbol AND ct.ts >= f.test_start AND ct.ts < f.test_end WHERE r_3 IS NOT NULL GROUP BY 1, 2, 3),
cm AS (SELECT e.symbol, e.fold, max(an) AS n_train, sum(tn) AS n_test, max(greatest(aup, adown) / an) AS base_rate,
  sum(CASE WHEN coalesce(up / n, aup / an) > 0.5 THEN tup ELSE tdown END) / sum(tn) AS marginal_acc, sum(CASE WHEN c = 'none' THEN tn ELSE 0 END) / sum(tn) AS none_frac
  FROM mte e JOIN mall USING (symbol, fold) LEFT JOIN mtr USING (symbol, fold, c) GROUP BY 1, 2)"""


def cat_marginal(spark, sf):
    rows = category_rows(spark, sf)
    return SC.category_marginal(rows, PE.folds_of(T.bars(spark, sf)), "r_3", "recent_category", PE.MIN_TRAIN, PE.TEST)


@query(
    "category_marginal",
    CATSQL.rstrip() + "," + MARG
    + f" SELECT symbol, fold, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, {r_('base_rate', 'base_rate')}, {r_('marginal_acc', 'marginal_acc')}, {r_('none_frac', 'none_frac')} FROM cm",
)
def category_marginal(spark, sf):
    return rounded(cat_marginal(spark, sf), 9)


@query(
    "marginal_summary",
    CATSQL.rstrip() + "," + MARG
    + f""" SELECT symbol, count(*) AS n_folds, {r_('avg(marginal_acc - base_rate) * 100', 'mean_delta_pp', 7)}, {r_('sum((marginal_acc - base_rate) * n_test) / sum(n_test) * 100', 'weighted_delta_pp', 7)},
    count(*) FILTER (marginal_acc - base_rate > 0) AS folds_beating_base_rate FROM cm GROUP BY 1""",
)
def marginal_summary(spark, sf):
    return rounded(SC.marginal_summary(cat_marginal(spark, sf), ["symbol"]), 7)


def magnitude_rows(spark, sf):
    t = Y.targets(T.bars(spark, sf), (12,))
    return settle(t.join(PJ.decayed(spark, sf), ["symbol", "t"]).withColumn("abs_r_12", F.abs("r_12")))


MAGSQL = with_(BARS, TARGETS, PJ.NEWS, PJ.DECAY, "\nmr AS (SELECT t.symbol, t.ts, abs(t.r_12) AS v, max_magnitude_60m AS m FROM tg t JOIN dg USING (symbol, ts) WHERE t.r_12 IS NOT NULL)")


@query(
    "magnitude_buckets",
    MAGSQL
    + f""", ed AS (SELECT symbol, list_sort(list_distinct([min(m), quantile_cont(m, 0.25), quantile_cont(m, 0.5), quantile_cont(m, 0.75), max(m)])) AS e FROM mr WHERE m > 0 GROUP BY 1),
    bk AS (SELECT mr.symbol, v, CASE WHEN m > 0 THEN ['q1_low', 'q2', 'q3', 'q4_high'][greatest(len(list_filter(e, lambda z: z < m)) - 1, 0) + 1] ELSE 'no_recent_news' END AS bucket FROM mr LEFT JOIN ed USING (symbol))
    SELECT symbol, bucket, count(*) AS n, {r_('avg(v)', 'mean', 8)}, {r_('stddev_samp(v)', 'std', 8)}, list_position(['no_recent_news', 'q1_low', 'q2', 'q3', 'q4_high'], bucket) - 1 AS bucket_order FROM bk GROUP BY 1, 2""",
)
def magnitude_buckets(spark, sf):
    d = magnitude_rows(spark, sf)
    # The slot maximum and a plain maximum are the same number; rounding guards the edges all the same.
    return rounded(SC.magnitude_table(d, ["symbol"], "abs_r_12", "max_magnitude_60m"), 8)


@query(
    "magnitude_regress",
    MAGSQL + f", q AS (SELECT symbol, {FIT} FROM (SELECT symbol, m AS x, v AS y FROM mr) GROUP BY 1) SELECT symbol, {FIT_OUT} FROM q",
)
def magnitude_regress(spark, sf):
    return fit_out(ST.linear_fit(magnitude_rows(spark, sf), ["symbol"], "max_magnitude_60m", "abs_r_12"), "symbol")


NOVM = f"""
sym AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT symbol FROM bars)),
own AS (SELECT n.asset, n.id, v.p, round(n.novelty, 9) AS novelty, s.symbol FROM nov n JOIN vec v ON v.id = n.id JOIN sym s ON n.asset % s.k = s.i),
nvl AS (SELECT o.*, ln(s.exit_close / s.entry_close) AS log_return FROM own o
  ASOF JOIN (SELECT symbol, ts, close AS entry_close, lead(close, 24) OVER (PARTITION BY symbol ORDER BY ts) AS exit_close FROM bars) s ON s.symbol = o.symbol AND s.ts >= o.p WHERE s.exit_close IS NOT NULL),
ntr AS (SELECT w.fold, l.* FROM folds w JOIN nvl l ON l.symbol = w.symbol AND l.p + INTERVAL 24 HOUR <= w.test_start),
ned AS (SELECT symbol, fold, quantile_cont(novelty, 0.25) AS e1, quantile_cont(novelty, 0.5) AS e2, quantile_cont(novelty, 0.75) AS e3 FROM ntr GROUP BY 1, 2 HAVING count(*) >= 50),
ntb AS (SELECT t.symbol, t.fold, CAST(novelty >= e1 AS INT) + CAST(novelty >= e2 AS INT) + CAST(novelty >= e3 AS INT) AS b, count(*) FILTER (log_return > 0) AS up, count(*) FILTER (log_return < 0) AS down, count(*) AS n FROM ntr t JOIN ned USING (symbol, fold) GROUP BY 1, 2, 3),
nta AS (SELECT symbol, fold, sum(up) AS aup, sum(down) AS adown, sum(n) AS an FROM ntb GROUP BY 1, 2),
nte AS (SELECT w.symbol, w.fold, CAST(novelty >= e1 AS INT) + CAST(novelty >= e2 AS INT) + CAST(novelty >= e3 AS INT) AS b, count(*) FILTER (log_return > 0) AS tup, count(*) FILTER (log_return < 0) AS tdown, count(*) AS tn
  FROM folds w JOIN nvl l ON l.symbol = w.symbol AND l.p >= w.test_start AND l.p < w.test_end JOIN ned ON ned.symbol = w.symbol AND ned.fold = w.fold GROUP BY 1, 2, 3)"""


@query(
    "novelty_marginal",
    with_(BARS, PE.FOLDS, PJ.VEC, NOVM)
    + f"""SELECT e.symbol, e.fold, CAST(max(an) AS BIGINT) AS n_train, CAST(sum(tn) AS BIGINT) AS n_test, {r_('max(greatest(aup, adown) / an)', 'base_rate')},
    {r_('sum(CASE WHEN coalesce(up / n, aup / an) > 0.5 THEN tup ELSE tdown END) / sum(tn)', 'marginal_acc')} FROM nte e JOIN nta USING (symbol, fold) LEFT JOIN ntb USING (symbol, fold, b) GROUP BY 1, 2""",
)
def novelty_marginal(spark, sf):
    """Does novelty say anything about the next day's direction of the asset's own symbol?

    Assets are numbers here: each is hung on one symbol in turn. Time-purged windows, quartile buckets.
    """
    bars = settle(T.bars(spark, sf))
    names = settle(bars.agg(F.array_sort(F.collect_set("symbol")).alias("names")).select(F.posexplode("names").alias("i", "symbol")))
    at = (F.col("asset") % F.lit(max(names.count(), 1))).cast("int")
    items = PJ.V.novelty(PJ.vectors(spark, sf), ["asset"]).withColumn("i", at).join(names, "i").drop("i")
    items = items.withColumn("novelty", F.round("novelty", 9))
    lab = settle(Y.label_news(items, bars, steps=24))
    windows = PE.folds_of(bars).select("symbol", "fold", "test_start", "test_end")
    return rounded(SC.bucket_marginal(lab, windows, ["symbol"], "novelty", "log_return", 4, T.DAY), 9)


# --- drift baseline -----------------------------------------------------------------------------------
DRIFT = ["base_ret", "bb_width", "ret_std_144", "funding_rate"]


DRIFT_BINS = (
    with_(BARS, RETS,
          f"\nl AS (SELECT r.symbol, r.ts, 4 * ({sfull('close', 'stddev_pop', 20)}) / ({sfull('close', 'avg', 20)}) AS bb_width, {sfull('ret', 'stddev_samp', 144)} AS ret_std_144 FROM rets r)",
          "\nc AS (SELECT r.symbol, r.ts, CASE WHEN r.symbol <> 'click' THEN b.ret END AS base_ret FROM rets r LEFT JOIN rets b ON b.symbol = 'click' AND b.ts = r.ts)",
          "\nd AS (SELECT symbol, 'base_ret' AS feature, round(base_ret, 10) AS x FROM c UNION ALL SELECT symbol, 'bb_width', round(bb_width, 10) FROM l UNION ALL SELECT symbol, 'ret_std_144', round(ret_std_144, 10) FROM l UNION ALL SELECT symbol, 'funding_rate', NULL FROM l)",
          "\ne AS (SELECT symbol, feature, list_sort(list_distinct([" + ", ".join(f"quantile_cont(x, {i / 10})" for i in range(11)) + "])) AS e, avg(x) AS mean, stddev_samp(x) AS std, count(x) AS n FROM d GROUP BY 1, 2)",
          "\nb AS (SELECT d.symbol, d.feature, greatest(len(list_filter(e, lambda z: z < x)) - 1, 0) AS bin FROM d JOIN e ON e.symbol = d.symbol AND e.feature = d.feature WHERE x IS NOT NULL)")
)


@query(
    "drift_baseline",
    DRIFT_BINS
    + """SELECT e.symbol, e.feature, round(mean, 7) + 0.0 AS mean, round(std, 7) AS std, CASE WHEN n > 0 THEN len(e) END AS n_edges, round(e[1], 7) + 0.0 AS first_edge, round(e[-1], 7) + 0.0 AS last_edge,
    round(e[6], 7) + 0.0 AS mid_edge, round((SELECT count(*) FROM b WHERE b.symbol = e.symbol AND b.feature = e.feature AND bin = 0) / nullif(n, 0), 8) AS first_fraction,
    round((SELECT count(*) FROM b WHERE b.symbol = e.symbol AND b.feature = e.feature AND bin = 9) / nullif(n, 0), 8) AS last_fraction FROM e""",
)
def drift_baseline(spark, sf):
    d = Y.dataset(T.bars(spark, sf), horizons=(1,), base=T.BASE_SYMBOL)
    d = settle(d.select("symbol", *[F.round(c, 10).alias(c) for c in DRIFT if c in d.columns]))
    out = SC.drift_baseline(d, DRIFT)
    e, f = F.col("bin_edges"), F.col("bin_fractions")
    # The whole arrays are in the operator's result; the query shows their ends and size.
    return out.select(
        "symbol", "feature", (F.round("mean", 7) + 0.0).alias("mean"), F.round("std", 7).alias("std"),
        F.when(e.isNotNull(), F.size(e)).alias("n_edges"), (F.round(e[0], 7) + 0.0).alias("first_edge"),
        (F.round(F.element_at(e, -1), 7) + 0.0).alias("last_edge"), (F.round(F.get(e, F.lit(5)), 7) + 0.0).alias("mid_edge"),
        F.round(f[0], 8).alias("first_fraction"), F.round(F.get(f, F.lit(9)), 8).alias("last_fraction"),
    )


@query(
    "drift_bins",
    DRIFT_BINS
    + """SELECT e.symbol, e.feature, k AS bin, round(e.e[k + 1], 7) + 0.0 AS lower_edge, round(coalesce(e.e[k + 2], e.e[k + 1]), 7) + 0.0 AS upper_edge,
    round(coalesce(m, 0) / n, 8) AS fraction FROM e JOIN range(0, 10) t(k) ON k <= greatest(len(e.e) - 2, 0)
    LEFT JOIN (SELECT symbol, feature, bin, count(*) AS m FROM b GROUP BY ALL) b ON b.symbol = e.symbol AND b.feature = e.feature AND b.bin = k WHERE n > 0""",
)
def drift_bins(spark, sf):
    """Every bin of the drift baseline: its edges and the share of rows in it."""
    d = Y.dataset(T.bars(spark, sf), horizons=(1,), base=T.BASE_SYMBOL)
    d = settle(d.select("symbol", *[F.round(c, 10).alias(c) for c in DRIFT if c in d.columns]))
    out = SC.drift_baseline(d, DRIFT).filter("bin_fractions is not null")
    out = out.select("symbol", "feature", "bin_edges", F.posexplode("bin_fractions").alias("bin", "f"))
    e, k = F.col("bin_edges"), F.col("bin")
    return out.select(
        "symbol", "feature", k.cast("long").alias("bin"), (F.round(F.get(e, k), 7) + 0.0).alias("lower_edge"),
        (F.round(F.coalesce(F.get(e, k + 1), F.get(e, k)), 7) + 0.0).alias("upper_edge"), F.round("f", 8).alias("fraction"),
    )


# --- paired tests ---------------------------------------------------------------------------------------
PAIRED = """, o AS (SELECT symbol, variant, fold, sum(pinball_loss * n_test) / sum(n_test) AS v FROM qf GROUP BY 1, 2, 3),
d AS (SELECT a.symbol, b.v - a.v AS d FROM o a JOIN o b ON a.symbol = b.symbol AND a.fold = b.fold AND a.variant = 'a' AND b.variant = 'b' WHERE b.v - a.v IS NOT NULL)"""


def deltas(spark, sf):
    return ST.paired_deltas(E.fold_overall(PE.quantile_folds_df(spark, sf)), ["symbol"], "overall_pinball_loss", "a", "b")


@query(
    "paired_t",
    PE.QSQL + PAIRED.lstrip()
    + f" SELECT symbol, count(*) AS n_folds, {r_('avg(d)', 'mean_delta')}, {r_('stddev_samp(d)', 'std_delta')}, count(*) FILTER (d < 0) AS folds_favoring, {r_('avg(d) / (stddev_samp(d) / sqrt(count(*)))', 't_stat', 6)} FROM d GROUP BY 1",
)
def paired_t(spark, sf):
    d = deltas(spark, sf)
    return d.select(
        "symbol", "n_folds", (F.round("mean_delta", 9) + 0.0).alias("mean_delta"), F.round("std_delta", 9).alias("std_delta"),
        "folds_favoring", (F.round("t_stat", 6) + 0.0).alias("t_stat"),
    )


# The test of the fold deltas with its tails, and the variant's own level.
TESTED = f""",
g AS (SELECT symbol, count(*) AS n_folds, avg(d) AS mean_delta, stddev_samp(d) AS std_delta, count(*) FILTER (d < 0) AS folds_favoring FROM d GROUP BY 1),
h AS (SELECT *, std_delta / sqrt(n_folds) AS se, mean_delta / nullif(std_delta / sqrt(n_folds), 0) AS t_stat, {t_quantile('0.975', '(n_folds - 1)')} AS crit, {t_quantile('0.8', '(n_folds - 1)')} AS back FROM g),
tt AS (SELECT *, {t_two_sided('t_stat', '(n_folds - 1)')} AS p_value, (crit + back) * se AS min_detectable, mean_delta - crit * se AS ci_lo, mean_delta + crit * se AS ci_hi FROM h)"""
TESTED_OUT = "symbol, n_folds, folds_favoring, " + ", ".join(r_(c, c, 8) for c in ("mean_delta", "std_delta", "t_stat", "p_value", "min_detectable", "ci_lo", "ci_hi"))


@query("paired_t_p", PE.QSQL + PAIRED.lstrip() + TESTED + f" SELECT {TESTED_OUT} FROM tt")
def paired_t_p(spark, sf):
    """p-value, smallest detectable effect and 95 % t-interval of the fold deltas."""
    return rounded(ST.paired_test(deltas(spark, sf)), 8)


@query(
    "corridor_pass_bar",
    PE.QSQL + PAIRED.lstrip() + TESTED
    + f""",
bs AS (SELECT symbol, avg(v) AS base FROM o WHERE variant = 'a' GROUP BY 1),
cf AS (SELECT symbol, quantile, fold, sum(coverage * n_test) / sum(n_test) AS c FROM qf WHERE variant = 'b' AND quantile IN (0.1, 0.9) GROUP BY 1, 2, 3),
cq AS (SELECT symbol, quantile, count(*) AS n, count(*) FILTER (abs(c - quantile) <= 0.03) AS k FROM cf GROUP BY 1, 2),
cv AS (SELECT symbol, bool_and(k > n / 2.0) AS passes_coverage FROM cq GROUP BY 1),
z AS (SELECT tt.*, base, passes_coverage, -mean_delta / base AS relative_gain FROM tt JOIN bs USING (symbol) JOIN cv USING (symbol))
SELECT {TESTED_OUT}, {r_('base', 'base', 8)}, passes_coverage, {r_('relative_gain', 'relative_gain', 8)}, relative_gain >= 0.01 AS passes_gain,
  p_value < 0.05 AND mean_delta < 0 AS passes_significance, relative_gain >= 0.01 AND p_value < 0.05 AND mean_delta < 0 AND passes_coverage AS passes FROM z""",
)
def corridor_pass_bar(spark, sf):
    """Pre-registered corridor bar: one percent better pinball, significant, most folds calibrated."""
    from tidemark.operators.gates import corridor_bar

    qf = settle(PE.quantile_folds_df(spark, sf))
    return rounded(corridor_bar(qf, "a", "b"), 8)


# --- parameter grid --------------------------------------------------------------------------------------
AXES = {"window": [6, 12, 36], "scale": [0.5, 1.0, 2.0]}
GRID_H = [1, 6, 12]


def grid_folds(spark, sf):
    """Fold metrics of the forecast "mean of the last w returns times scale times h" on the first folds."""
    w = block_window(X.KEYS, "t")
    d = X.blocked(T.bars(spark, sf), 37, 12).withColumn("ret", X.ret_col(w))
    d = d.withColumns(
        {f"m_{n}": F.round(full(F.col("ret"), F.avg, w, n), 12) for n in AXES["window"]}
        | Y.target_cols(w, GRID_H, T.HOUR)
    ).filter("own")
    te = S.with_test_fold(d, PE.folds_of(T.bars(spark, sf)), PE.MIN_TRAIN, PE.TEST)
    te = te.filter(F.col("fold").isin(0, 1, 2))
    cells = []
    for n in AXES["window"]:
        for s in AXES["scale"]:
            for h in GRID_H:
                a, p = F.col(f"r_{h}"), F.col(f"m_{n}") * (s * h)
                cells.append((
                    {"cell": f"w{n}", "window": n, "scale": s, "horizon": h},
                    {"mae": M.mae(a, p), "directional_accuracy": M.directional_accuracy(a, p), "n_test": M.n_pairs(a, p)},
                ))
    return E.stacked(te, ["symbol", "fold"], cells)


GRID = with_(
    BARS, RETS, TARGETS, PE.FOLDS,
    "\ngm AS (SELECT symbol, ts, " + ", ".join(f"round({sfull('ret', 'avg', n)}, 12) AS m_{n}" for n in AXES["window"]) + " FROM rets)",
    "\ngl AS (" + " UNION ALL ".join(
        f"SELECT f.symbol, f.fold, 'w{n}' AS cell, {n} AS \"window\", CAST({s} AS DOUBLE) AS scale, {h} AS horizon, t.r_{h} AS a, g.m_{n} * {s * h} AS p FROM folds f JOIN gm g ON g.symbol = f.symbol AND g.ts >= f.test_start AND g.ts < f.test_end JOIN tg t ON t.symbol = g.symbol AND t.ts = g.ts WHERE f.fold IN (0, 1, 2)"
        for n in AXES["window"] for s in AXES["scale"] for h in GRID_H
    ) + ")",
    """
gf AS (SELECT symbol, fold, cell, "window", scale, horizon, avg(abs(a - p)) AS mae, avg(CASE WHEN a IS NOT NULL AND p IS NOT NULL THEN CAST(sign(a) = sign(p) AS INT) END) AS directional_accuracy, count(*) FILTER (a IS NOT NULL AND p IS NOT NULL) AS n_test FROM gl GROUP BY ALL),
gp AS (SELECT cell, "window", scale, round(sum(mae * n_test) / sum(n_test), 9) AS mae, round(sum(directional_accuracy * n_test) / sum(n_test), 9) AS directional_accuracy, count(DISTINCT fold) AS n_folds, CAST(sum(n_test) AS BIGINT) AS n_test_total FROM gf WHERE n_test > 0 GROUP BY ALL),
gs AS (SELECT gp.*, directional_accuracy * 100 AS da_pct, (directional_accuracy - b_da) * 100 AS delta_vs_default_pp, (mae / b_mae - 1) * 100 AS mae_vs_default_pct FROM gp, (SELECT directional_accuracy AS b_da, mae AS b_mae FROM gp WHERE "window" = 12 AND scale = 1.0))""",
)


def grid_scored(spark, sf):
    p = E.pool(grid_folds(spark, sf), ["mae", "directional_accuracy"], ["cell", "window", "scale"])
    p = rounded(p, 9)
    return G.versus_default(p, (F.col("window") == 12) & (F.col("scale") == 1.0))


@query(
    "param_grid_screen",
    GRID + f'SELECT cell, "window", scale, mae, directional_accuracy, n_folds, n_test_total, {r_("da_pct", "da_pct", 6)}, {r_("delta_vs_default_pp", "delta_vs_default_pp", 6)}, {r_("mae_vs_default_pct", "mae_vs_default_pct", 6)} FROM gs',
)
def param_grid_screen(spark, sf):
    d = grid_scored(spark, sf)
    return d.select(
        "cell", "window", "scale", "mae", "directional_accuracy", "n_folds", "n_test_total",
        *[(F.round(c, 6) + 0.0).alias(c) for c in ("da_pct", "delta_vs_default_pp", "mae_vs_default_pct")],
    )


@query(
    "param_grid_finalists",
    GRID
    + """SELECT cell, "window", scale, directional_accuracy, mae FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY directional_accuracy DESC, mae) AS k FROM gs) WHERE k = 1 ORDER BY directional_accuracy DESC, mae, cell LIMIT 2""",
)
def param_grid_finalists(spark, sf):
    """Top two distinct cells, each with its best scale."""
    return G.finalists(grid_scored(spark, sf), 2).select("cell", "window", "scale", "directional_accuracy", "mae")


@query(
    "grid_marginals",
    GRID
    + f"""SELECT axis, level, {r_('avg(da_pct)', 'mean', 6)}, {r_('max(da_pct)', 'max', 6)}, {r_('min(da_pct)', 'min', 6)}, count(*) AS n FROM (
      SELECT 'window' AS axis, CAST("window" AS VARCHAR) AS level, da_pct FROM gs UNION ALL SELECT 'scale', CAST(scale AS VARCHAR), da_pct FROM gs) GROUP BY 1, 2""",
)
def grid_marginals(spark, sf):
    return rounded(G.marginals(grid_scored(spark, sf), ["window", "scale"]))


@query(
    "grid_todo",
    """WITH g AS (SELECT w AS "window", s AS scale, f AS fold FROM (VALUES (6), (12), (36)) a(w), (VALUES (0.5), (1.0), (2.0)) b(s), (SELECT DISTINCT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) / 10 AS INT) AS f FROM (SELECT date_trunc('day', ts) AS ts FROM events)) c)
    SELECT "window", CAST(scale AS DOUBLE) AS scale, fold FROM g WHERE NOT EXISTS (SELECT 1 FROM events e WHERE floor(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', e.ts)) / 10) = g.fold AND e.event_type = 'signup' AND e.value > 340)""".replace("CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) / 10 AS INT)", "CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', ts) / 10) AS INT)"),
)
def grid_todo(spark, sf):
    """Planned (cell, fold) work without a finished row: folds with a large 'signup' event count as done."""
    from tidemark.operators.blocks import floor_div
    from tidemark.operators.upserts import todo

    fold = floor_div(F.col("t") - F.lit(1_704_067_200_000_000), 10 * T.DAY).cast("int").alias("fold")
    tr = T.trades(spark, sf)
    folds = tr.select(fold).distinct()
    planned = folds
    for name, values in AXES.items():
        planned = planned.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    done = tr.filter((F.col("symbol") == "signup") & (F.col("qty") > 340)).select(fold).distinct()
    return todo(planned, done, ["fold"]).select("window", "scale", "fold")


# --- re-scoring and per-horizon comparison -------------------------------------------------------------------
@query(
    "rescore_compare",
    with_(BARS, TARGETS, PJ.NEWS, PJ.DECAY, PJ.DECAY.replace("dc AS", "dc2 AS").replace("dg AS", "dg2 AS").replace("FROM dc ", "FROM dc2 ").replace("n.pos - n.neg AS s", "n.pos * n.pos - n.neg * n.neg AS s"))
    + f"""SELECT 'first' AS scorer, t.symbol, count(*) AS n, {r_('avg(sentiment_weighted)', 'mean_sentiment', 7)}, {r_('corr(sentiment_weighted, r_6)', 'corr_r_6', 7)} FROM tg t JOIN dg USING (symbol, ts) WHERE r_6 IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'second', t.symbol, count(*), {r_('avg(sentiment_weighted)', 'mean_sentiment', 7)}, {r_('corr(sentiment_weighted, r_6)', 'corr_r_6', 7)} FROM tg t JOIN dg2 USING (symbol, ts) WHERE r_6 IS NOT NULL GROUP BY 2""",
)
def rescore_compare(spark, sf):
    """The same plan under two scorers, nothing written back: does the signal follow the scorer?"""
    t = Y.targets(T.bars(spark, sf), (6,)).filter("r_6 is not null").select("symbol", "t", "r_6")
    news = PJ.news_items(spark, sf)
    pos, neg = F.col("sentiment_pos"), F.col("sentiment_neg")
    out = None
    for name, items in (("first", news), ("second", news.withColumns({"sentiment_pos": pos * pos, "sentiment_neg": neg * neg}))):
        ev = {k: F.array_contains("kinds", k) for k in PJ.WORDS}
        d = N.decay_features(items, T.bars(spark, sf), ["symbol"], T.HOUR, ev).join(t, ["symbol", "t"])
        d = d.groupBy(F.lit(name).alias("scorer"), "symbol").agg(
            F.count(F.lit(1)).alias("n"), (F.round(F.avg("sentiment_weighted"), 7) + 0.0).alias("mean_sentiment"),
            (F.round(F.corr("sentiment_weighted", "r_6"), 7) + 0.0).alias("corr_r_6"),
        )
        out = d if out is None else out.unionByName(d)
    return out


@query(
    "candidate_vs_production",
    PE.PT
    + f""", g AS (SELECT symbol, horizon, variant, {PE.POOL.format(m='mae')} AS mae, {PE.POOL.format(m='directional_accuracy')} AS da FROM pf WHERE n_test > 0 GROUP BY ALL)
    SELECT c.symbol, c.horizon, {r_('c.mae', 'mae')}, {r_('p.mae', 'production_mae')}, {r_('c.mae - p.mae', 'mae_delta')}, {r_('c.da - p.da', 'da_delta')}
    FROM g c LEFT JOIN g p ON p.symbol = c.symbol AND p.horizon = c.horizon AND p.variant = 'a' AND p.horizon <= 6 WHERE c.variant = 'b'""",
)
def candidate_vs_production(spark, sf):
    """Candidate metrics per horizon beside production's, which serves only the first six horizons."""
    ms = ["mae", "directional_accuracy"]
    p = settle(E.pool(PE.point_folds_df(spark, sf), ms, ["symbol", "variant", "horizon"]))
    prod = p.filter("variant = 'a' and horizon <= 6").select("symbol", "horizon", F.col("mae").alias("production_mae"), F.col("directional_accuracy").alias("production_da"))
    d = p.filter("variant = 'b'").join(prod, ["symbol", "horizon"], "left")
    return rounded(
        d.select(
            "symbol", "horizon", "mae", "production_mae", (F.col("mae") - F.col("production_mae")).alias("mae_delta"),
            (F.col("directional_accuracy") - F.col("production_da")).alias("da_delta"),
        ),
        9,
    )


@query("feature_set_coverage")
def feature_set_coverage(spark, sf):
    """Every named feature set attached to the bars, with the share of rows that have all of its columns."""
    from tidemark.operators.models import FEATURE_SETS

    src = {"funding": T.funding(spark, sf), "trades": T.trades(spark, sf), "news": PJ.news_items(spark, sf)}
    out = None
    for name, attach in FEATURE_SETS.items():
        d, cols = attach(T.bars(spark, sf), src)
        ok = F.lit(True)
        for c in cols:
            ok = ok & F.col(c).isNotNull()
        d = d.groupBy(F.lit(name).alias("feature_set"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("int")).alias("coverage"))
        out = d if out is None else out.unionByName(d)
    return out
