"""Queries on decision tables. Inputs are metric and metadata tables derived from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import tables as T
from tidemark.operators import bootstrap as B, evaluation as E, gates as G, targets as Y
from tidemark.plans import evaluation as PE
from tidemark.plans.features import rounded
from tidemark.plans.registry import query
from tidemark.tables import read

# One "symbol" per customer. Flags come from the key, metrics from the customer's order values.
INPUTS = """
o AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o, avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY 1),
g AS (SELECT c_custkey AS k, c_custkey % 7 <> 0 AS has_production, c_custkey % 3 <> 0 AS schema_matches, c_custkey % 4 <> 0 AS has_quantiles, c_custkey % 6 <> 5 AS has_candidate,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS sanity, c_custkey % 2 = 0 AS coverage_ok, round(f, 4) AS candidate, round(o, 4) AS production, round(a, 4) AS naive,
  n * 20 AS n, (c_acctbal + 1000) / 110 AS acc_c, (c_acctbal + 1100) / 112 AS acc_p, 0.05 + (c_custkey % 11) / 100.0 AS lo, 0.84 + (c_custkey % 13) / 100.0 AS hi, c_custkey % 9 = 0 AS flag
  FROM customer LEFT JOIN o ON o_custkey = c_custkey)"""


def inputs(spark, sf):
    st = F.col("o_orderstatus")
    o = (
        read(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("k"))
        .agg(
            F.round(F.avg(F.when(st == "F", F.col("o_totalprice"))), 4).alias("candidate"),
            F.round(F.avg(F.when(st == "O", F.col("o_totalprice"))), 4).alias("production"),
            F.round(F.avg("o_totalprice"), 4).alias("naive"),
            (F.count(F.lit(1)) * 20).alias("n"),
        )
    )
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").select(
        k.alias("k"), (k % 7 != 0).alias("has_production"), (k % 3 != 0).alias("schema_matches"),
        (k % 4 != 0).alias("has_quantiles"), (k % 6 != 5).alias("has_candidate"),
        F.when(k % 5 != 0, k % 5 != 1).alias("sanity"), (k % 2 == 0).alias("coverage_ok"),
        ((F.col("c_acctbal") + 1000) / 110).alias("acc_c"), ((F.col("c_acctbal") + 1100) / 112).alias("acc_p"),
        (F.lit(0.05) + (k % 11) / 100.0).alias("lo"), (F.lit(0.84) + (k % 13) / 100.0).alias("hi"), (k % 9 == 0).alias("flag"),
    )
    return c.join(o, "k", "left")


c_ = F.col


@query(
    "gate_point",
    f"""WITH {INPUTS}, d AS (SELECT k, CASE WHEN NOT has_production THEN 'bootstrap' WHEN NOT schema_matches AND sanity = false THEN 'schema_drift_rejected_sanity' WHEN NOT schema_matches THEN 'schema_drift_push_as_candidate'
    WHEN (production - candidate) / production >= 0.005 THEN 'pushed_to_candidate' ELSE 'rejected' END AS decision FROM g)
    SELECT k, decision, CASE WHEN decision = 'bootstrap' THEN 'production' WHEN decision IN ('schema_drift_push_as_candidate', 'pushed_to_candidate') THEN 'candidate' END AS slot FROM d""",
)
def gate_point(spark, sf):
    d = inputs(spark, sf).withColumn(
        "decision", G.point_push(c_("has_production"), c_("schema_matches"), c_("candidate"), c_("production"), c_("sanity"))
    )
    return d.select("k", "decision", G.target_slot(c_("decision")).alias("slot"))


@query(
    "gate_corridor",
    f"""WITH {INPUTS}, d AS (SELECT k, CASE WHEN NOT has_production THEN 'bootstrap' WHEN NOT has_quantiles THEN CASE WHEN sanity = false THEN 'schema_drift_rejected_sanity' ELSE 'no_production_quantiles_push_as_candidate' END
    WHEN NOT schema_matches THEN CASE WHEN sanity = false THEN 'schema_drift_rejected_sanity' ELSE 'schema_drift_push_as_candidate' END WHEN NOT coverage_ok THEN 'rejected_miscalibrated'
    WHEN (production - candidate) / production >= 0.005 THEN 'pushed_to_candidate' ELSE 'rejected' END AS decision FROM g)
    SELECT k, decision, CASE WHEN decision = 'bootstrap' THEN 'production' WHEN decision LIKE '%candidate' THEN 'candidate' END AS slot FROM d""",
)
def gate_corridor(spark, sf):
    d = inputs(spark, sf).withColumn(
        "decision",
        G.corridor_push(c_("has_production"), c_("schema_matches"), c_("has_quantiles"), c_("candidate"), c_("production"), c_("coverage_ok"), c_("sanity")),
    )
    return d.select("k", "decision", G.target_slot(c_("decision")).alias("slot"))


@query(
    "gate_sanity",
    f"""WITH {INPUTS} SELECT k, CASE WHEN candidate IS NULL OR naive IS NULL OR acc_c IS NULL OR acc_p IS NULL THEN 'nan_metric' WHEN candidate > naive * 1.02 THEN 'mae_worse_than_naive' WHEN acc_c < acc_p THEN 'dir_acc_below_naive' ELSE 'ok' END AS point_reason,
    CASE WHEN candidate IS NULL OR naive IS NULL THEN 'nan_metric' WHEN NOT coverage_ok THEN 'coverage_not_calibrated' WHEN candidate > naive * 1.02 THEN 'pinball_worse_than_naive' ELSE 'ok' END AS corridor_reason FROM g""",
)
def gate_sanity(spark, sf):
    return inputs(spark, sf).select(
        "k",
        G.point_sanity(c_("candidate"), c_("acc_c"), c_("naive"), c_("acc_p")).alias("point_reason"),
        G.quantile_sanity(c_("candidate"), c_("naive"), c_("coverage_ok")).alias("corridor_reason"),
    )


@query(
    "gate_live",
    f"""WITH {INPUTS}, h AS (SELECT *, abs(lo - 0.1) <= 0.03 AND abs(hi - 0.9) <= 0.03 AS verified FROM g)
    SELECT k, verified, CASE WHEN NOT has_candidate THEN 'no_candidate' WHEN NOT has_production THEN 'no_production' WHEN NOT schema_matches THEN 'new_scheme_manual_promotion_required' WHEN coalesce(n, 0) < 100 THEN 'insufficient_samples'
      WHEN acc_c - acc_p >= 1.0 THEN 'accuracy_improved' WHEN flag THEN 'point_model_rejected' ELSE 'not_better' END AS point_decision,
    CASE WHEN NOT has_candidate THEN 'no_candidate' WHEN NOT has_production THEN 'no_production' WHEN NOT has_quantiles THEN 'no_new_quantiles' WHEN NOT schema_matches THEN 'new_scheme_manual_promotion_required' WHEN coalesce(n, 0) < 100 THEN 'insufficient_samples'
      WHEN verified THEN 'quantile_gain' ELSE 'quantile_unverified' END AS corridor_decision FROM h""",
)
def gate_live(spark, sf):
    d = inputs(spark, sf).withColumn("verified", G.corridor_verified(c_("lo"), c_("hi")))
    manual = ~c_("schema_matches")
    return d.select(
        "k", "verified",
        G.point_promotion(c_("has_candidate"), c_("has_production"), c_("n"), c_("acc_c"), c_("acc_p"), c_("flag"), manual).alias("point_decision"),
        G.quantile_promotion(c_("has_candidate"), c_("has_production"), c_("n"), c_("has_quantiles"), c_("verified"), manual).alias("corridor_decision"),
    )


# --- slot metadata derived from customers ------------------------------------------------------------
META = """
m AS (SELECT c_custkey AS k, 's' || c_custkey AS symbol, s.slot, c_custkey % 17 <> 0 OR s.slot = 'production' AS has_metadata, CASE WHEN c_custkey % 10 = 0 THEN [] ELSE ['rsi', 'atr', 'n' || c_nationkey] END AS feature_columns,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 8 = 0 AND s.slot = 'candidate' THEN 'stale' ELSE substr(sha256('rsi,atr,n' || c_nationkey), 1, 12) END AS schema_version,
  CASE WHEN c_custkey % 12 = 0 THEN []::BIGINT[] ELSE range(1, 2 + c_custkey % 3) END AS horizons, CASE WHEN c_custkey % 14 <> 0 THEN 'v' || (c_custkey % 4) END AS model_version,
  CASE WHEN c_custkey % 3 = 0 THEN ['0.1', '0.9'] ELSE [] END AS quantile_levels, range(1, 3) AS quantile_horizons, CASE WHEN c_custkey % 15 <> 0 THEN 'q' || (c_custkey % 5) END AS quantile_model_version,
  CASE WHEN c_custkey % 9 = 0 THEN 'other' ELSE CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 8 = 0 AND s.slot = 'candidate' THEN 'stale' ELSE substr(sha256('rsi,atr,n' || c_nationkey), 1, 12) END END AS quantile_schema_version,
  CASE WHEN s.slot = 'candidate' AND c_custkey % 4 < 2 THEN c_custkey % 4 = 1 END AS new_scheme
  FROM customer, (VALUES ('production'), ('candidate')) s(slot)),
f AS (SELECT k, symbol, slot, 'h' || h || '.txt' AS name FROM m, range(1, 4) r(h) WHERE (k + h) % 5 <> 0 UNION ALL SELECT k, symbol, slot, 'h' || h || '_q' || q || '.txt' FROM m, range(1, 3) r(h), (VALUES ('0.1'), ('0.9')) v(q) WHERE (k + h) % 7 <> 0)"""


def metadata(spark, sf):
    k = c_("c_custkey")
    names = F.array(F.lit("rsi"), F.lit("atr"), F.concat(F.lit("n"), c_("c_nationkey").cast("string")))
    from tidemark.functions.text import schema_version

    d = read(spark, sf, "customer").withColumn("slot", F.explode(F.array(F.lit("production"), F.lit("candidate"))))
    cand = c_("slot") == "candidate"
    schema = F.when(k % 10 == 0, F.lit(None)).when((k % 8 == 0) & cand, "stale").otherwise(schema_version(names))
    none = F.array().cast("array<string>")
    return d.select(
        k.alias("k"), F.concat(F.lit("s"), k.cast("string")).alias("symbol"), "slot",
        ((k % 17 != 0) | ~cand).alias("has_metadata"), F.when(k % 10 == 0, none).otherwise(names).alias("feature_columns"),
        schema.alias("schema_version"),
        F.when(k % 12 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), 1 + k % 3)).alias("horizons"),
        F.when(k % 14 != 0, F.concat(F.lit("v"), (k % 4).cast("string"))).alias("model_version"),
        F.when(k % 3 == 0, F.array(F.lit("0.1"), F.lit("0.9"))).otherwise(none).alias("quantile_levels"),
        F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("quantile_horizons"),
        F.when(k % 15 != 0, F.concat(F.lit("q"), (k % 5).cast("string"))).alias("quantile_model_version"),
        F.when(k % 9 == 0, "other").otherwise(schema).alias("quantile_schema_version"),
        F.when(cand & (k % 4 < 2), k % 4 == 1).alias("new_scheme"),
    )


def files(meta):
    k = c_("k")
    p = meta.select("k", "symbol", "slot", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("h")).filter((k + c_("h")) % 5 != 0)
    q = (
        meta.select("k", "symbol", "slot", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("h"))
        .filter((k + c_("h")) % 7 != 0)
        .withColumn("q", F.explode(F.array(F.lit("0.1"), F.lit("0.9"))))
    )
    return p.select("symbol", "slot", F.format_string("h%d.txt", "h").alias("name")).unionByName(
        q.select("symbol", "slot", F.format_string("h%d_q%s.txt", "h", "q").alias("name"))
    )


PROBLEMS = """
lv AS (SELECT * FROM m WHERE has_metadata),
pr AS (SELECT symbol, slot, 'metadata.json missing' AS problem FROM m WHERE NOT has_metadata
 UNION ALL SELECT symbol, slot, 'point: feature_columns missing/empty' FROM lv WHERE len(feature_columns) = 0
 UNION ALL SELECT symbol, slot, 'point: schema_version is not the hash of feature_columns' FROM lv WHERE len(feature_columns) > 0 AND schema_version IS DISTINCT FROM substr(sha256(array_to_string(feature_columns, ',')), 1, 12)
 UNION ALL SELECT symbol, slot, 'point: horizons missing/empty' FROM lv WHERE len(horizons) = 0
 UNION ALL SELECT symbol, slot, 'point: model_version missing' FROM lv WHERE model_version IS NULL
 UNION ALL SELECT e.symbol, e.slot, 'point: ' || e.name || ' missing' FROM (SELECT symbol, slot, 'h' || unnest(horizons) || '.txt' AS name FROM lv) e ANTI JOIN f USING (symbol, slot, name)
 UNION ALL SELECT e.symbol, e.slot, 'quantile: ' || e.name || ' missing' FROM (SELECT symbol, slot, 'h' || h || '_q' || q || '.txt' AS name FROM (SELECT symbol, slot, h, unnest(quantile_levels) AS q FROM (SELECT symbol, slot, quantile_levels, unnest(quantile_horizons) AS h FROM lv))) e ANTI JOIN f USING (symbol, slot, name)
 UNION ALL SELECT symbol, slot, 'quantile: quantile_model_version missing' FROM lv WHERE len(quantile_levels) > 0 AND quantile_model_version IS NULL
 UNION ALL SELECT symbol, slot, 'mixed schema: point and corridor differ' FROM lv WHERE len(quantile_levels) > 0 AND quantile_schema_version IS DISTINCT FROM schema_version)"""


@query("slot_audit", f"WITH {META}, {PROBLEMS} SELECT symbol, slot, problem FROM pr")
def slot_audit(spark, sf):
    m = metadata(spark, sf)
    return G.slot_problems(m, files(m))


@query(
    "gate_new_scheme",
    f"""WITH {META}, {PROBLEMS}, np AS (SELECT symbol, count(*) AS n FROM pr WHERE slot = 'candidate' GROUP BY 1),
    j AS (SELECT c.k, c.symbol, c.has_metadata AND coalesce(c.model_version, '') <> '' AS has_candidate, p.has_metadata AS has_production, c.new_scheme AS label, c.schema_version AS cs, CASE WHEN c.k % 16 = 1 THEN 'old' ELSE p.schema_version END AS ps,
      CASE c.k % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS sanity, CASE WHEN c.k % 2 = 0 THEN coalesce(np.n, 0) ELSE 0 END AS n FROM m c JOIN m p ON p.symbol = c.symbol AND p.slot = 'production' AND c.slot = 'candidate' LEFT JOIN np ON np.symbol = c.symbol)
    SELECT symbol, CASE WHEN NOT has_candidate THEN 'no_candidate' WHEN NOT has_production THEN 'no_production' WHEN label IS NULL THEN CASE WHEN cs IS NOT NULL AND cs IS NOT DISTINCT FROM ps THEN 'schema_unchanged' ELSE 'label_missing' END
      WHEN NOT label THEN 'not_new_scheme' WHEN cs IS NULL OR cs IS NOT DISTINCT FROM ps THEN 'schema_unchanged' WHEN n > 0 THEN 'candidate_inconsistent' WHEN sanity IS NULL THEN 'sanity_missing' WHEN NOT sanity THEN 'sanity_failed' ELSE 'promote_new_scheme' END AS decision,
      CASE WHEN has_candidate AND label IS NULL AND cs IS NOT NULL AND cs IS DISTINCT FROM ps THEN true ELSE label END AS label_after FROM j""",
)
def gate_new_scheme(spark, sf):
    m = metadata(spark, sf)
    n = G.slot_problems(m, files(m)).filter("slot = 'candidate'").groupBy("symbol").agg(F.count(F.lit(1)).alias("problems"))
    cand = m.filter("slot = 'candidate'").select(
        "k", "symbol", (c_("has_metadata") & (F.coalesce("model_version", F.lit("")) != "")).alias("has_candidate"),
        c_("new_scheme").alias("label"), c_("schema_version").alias("cs"),
    )
    prod = m.filter("slot = 'production'").select("symbol", c_("has_metadata").alias("has_production"), c_("schema_version").alias("ps0"))
    k = c_("k")
    # Merge joins: the planner takes rows exploded from a table for no more than the table, and would broadcast them.
    d = cand.join(prod.hint("merge"), "symbol").join(n.hint("merge"), "symbol", "left").withColumns(
        {
            "ps": F.when(k % 16 == 1, "old").otherwise(c_("ps0")),
            "sanity": F.when(k % 5 != 0, k % 5 != 1),
            "n": F.when(k % 2 == 0, F.coalesce("problems", F.lit(0))).otherwise(0),
        }
    )
    return d.select(
        "symbol",
        G.new_scheme_promotion(c_("has_candidate"), c_("has_production"), c_("label"), c_("cs"), c_("ps"), c_("sanity"), c_("n")).alias("decision"),
        G.legacy_label(c_("has_candidate"), c_("label"), c_("cs"), c_("ps")).alias("label_after"),
    )


@query(
    "metadata_merge",
    """WITH b AS (SELECT c_custkey AS k, 's' || c_custkey AS symbol, 'v' || (c_custkey % 4) AS mv, 'q' || (c_custkey % 5) AS qv, 'n' || c_nationkey AS sv FROM customer)
    SELECT symbol, CASE WHEN k % 3 = 0 THEN 'model_version=' || mv || ';quantile_model_version=new;schema_version=' || sv WHEN k % 3 = 1 THEN 'model_version=new;quantile_model_version=' || qv || ';schema_version=' || sv ELSE 'model_version=new' END AS merged,
      CASE WHEN k % 3 = 0 THEN 'model_version=' || mv || ';schema_version=' || sv WHEN k % 3 = 1 THEN 'model_version=new;schema_version=' || sv ELSE 'model_version=new' END AS point_part,
      CASE WHEN k % 3 = 0 THEN 'quantile_model_version=new' WHEN k % 3 = 1 THEN 'quantile_model_version=' || qv ELSE '' END AS corridor_part FROM b""",
)
def metadata_merge(spark, sf):
    """Point-only and corridor-only pushes onto a full slot, and a push onto an empty one."""
    k = c_("c_custkey")
    old = F.when(
        k % 3 != 2,
        F.create_map(
            F.lit("model_version"), F.concat(F.lit("v"), (k % 4).cast("string")),
            F.lit("quantile_model_version"), F.concat(F.lit("q"), (k % 5).cast("string")),
            F.lit("schema_version"), F.concat(F.lit("n"), c_("c_nationkey").cast("string")),
        ),
    )
    push = F.create_map(F.when(k % 3 == 0, "quantile_model_version").otherwise("model_version"), F.lit("new"))
    d = read(spark, sf, "customer").select(F.concat(F.lit("s"), k.cast("string")).alias("symbol"), G.merge_metadata(old, push).alias("m"))

    def text(m):
        return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")

    return d.select(
        "symbol", text(c_("m")).alias("merged"), text(G.point_half(c_("m"))).alias("point_part"), text(G.quantile_half(c_("m"))).alias("corridor_part")
    )


WINDOWS = {"1h": T.HOUR, "24h": T.DAY, "7d": 7 * T.DAY, "30d": 30 * T.DAY, "all": None}


@query(
    "live_compare",
    PE.with_(PE.BARS, PE.RETS, PE.TARGETS, PE.PRED_SQL, PE.QP,
             "\nrs AS (SELECT t.symbol, CASE WHEN p.pos % 2 = 0 THEN 'production' ELSE 'candidate' END AS slot, 'v' || (p.pos % 4) AS version, t.ts + INTERVAL 6 HOUR AS rt, t.r_6 AS a, p.ret_mean_6 * 6 AS p, q.pct_10 * sqrt(6) AS q10, q.pct_90 * sqrt(6) AS q90 FROM tg t JOIN pr p USING (symbol, ts) JOIN qp q USING (symbol, ts) WHERE t.r_6 IS NOT NULL)",
             "\nww AS (SELECT * FROM (VALUES ('1h', 1), ('24h', 24), ('7d', 168), ('30d', 720), ('all', 1000000)) v(\"window\", h))")
    + """SELECT symbol, slot, version, "window", count(p) AS n, round(avg(CAST(sign(a) = sign(p) AS INT)) * 100, 7) AS directional_accuracy, round(avg(CAST(a <= q10 AS INT)), 9) AS q10_coverage, round(avg(CAST(a <= q90 AS INT)), 9) AS q90_coverage
    FROM (SELECT rs.*, ww."window", CASE WHEN true THEN 1 END AS z FROM rs JOIN ww ON rs.rt > TIMESTAMP '2024-01-31' - INTERVAL 1 HOUR * h) WHERE true GROUP BY ALL HAVING count(p) > 0""".replace("avg(CAST(sign(a) = sign(p) AS INT))", "avg(CASE WHEN p IS NOT NULL THEN CAST(sign(a) = sign(p) AS INT) END)"),
)
def live_compare(spark, sf):
    """Resolved six-bar predictions of alternating slots and versions, scored per trailing window."""
    d = PE.predicted(spark, sf, True).filter("r_6 is not null")
    q = PE.QPREDS["a"]
    rows = d.select(
        "symbol", F.when(c_("pos") % 2 == 0, "production").otherwise("candidate").alias("slot"),
        F.concat(F.lit("v"), (c_("pos") % 4).cast("string")).alias("version"), (c_("t") + F.lit(6 * T.HOUR)).alias("resolved_t"),
        c_("r_6").alias("actual"), (c_("ret_mean_6") * 6).alias("predicted"), q(6, 0.1).alias("q10"), q(6, 0.9).alias("q90"),
    )
    now = F.lit(1_704_067_200_000_000 + 30 * T.DAY)
    out = G.live_compare(rows, WINDOWS, now)
    return out.select(
        "symbol", "slot", "version", "window", "n", F.round("directional_accuracy", 7).alias("directional_accuracy"),
        F.round("q10_coverage", 9).alias("q10_coverage"), F.round("q90_coverage", 9).alias("q90_coverage"),
    )


@query(
    "mae_pass_bar",
    PE.PT
    + f""", g AS (SELECT symbol, variant, {PE.POOL.format(m='mae')} AS mae FROM pf WHERE n_test > 0 GROUP BY ALL)
    SELECT g.symbol, g.variant, round((g.mae - z.mae) / z.mae, 9) + 0.0 AS mae_pct, (g.mae - z.mae) / z.mae <= -0.005 AS passes FROM g JOIN g z ON z.symbol = g.symbol AND z.variant = 'a'""",
)
def mae_pass_bar(spark, sf):
    p = E.pool(PE.point_folds_df(spark, sf), ["mae"], ["symbol", "variant"]).select("symbol", "variant", "mae")
    d = G.mae_bar(E.versus_level(p, ["symbol"], "variant", "a", "mae"))
    return rounded(d.select("symbol", "variant", "mae_pct", "passes"), 9)


@query("direction_pass_bar", f"SELECT symbol, ci_lo_pp, ci_lo_pp > 0 AS passes FROM ({PE._boot_sql()}) WHERE horizon = 'pooled'")
def direction_pass_bar(spark, sf):
    d = G.direction_bar(B.block_bootstrap(PE.daily_df(spark, sf), "a", "b", Y.HORIZONS, 7, PE.N_BOOT, 0))
    return d.select("symbol", (F.round("ci_lo_pp", 7) + 0.0).alias("ci_lo_pp"), "passes")


@query("finalist_verdicts")
def finalist_verdicts(spark, sf):
    """Select and judge fold sets, bootstrapped apart, then the pass rule."""
    from tidemark.operators import grid as GR, splits as S
    from tidemark.session import settle

    daily = settle(E.daily_stats(PE.test_rows(spark, sf), PE.PREDS, Y.HORIZONS, extra=["fold"]))
    out = None
    for name, folds in (("select", (0, 1)), ("judge", (2, 3))):
        d = daily.filter(F.col("fold").isin(*folds))
        b = B.block_bootstrap(d, "a", "b", Y.HORIZONS, 7, 500, 0).filter("horizon = 'pooled'")
        b = b.select("symbol", F.lit("b").alias("variant"), F.lit(name).alias("fold_set"), "delta_da_pp", "ci_lo_pp")
        out = b if out is None else out.unionByName(b)
    return GR.verdicts(out)
