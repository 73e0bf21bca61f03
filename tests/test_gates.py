"""Decision tables, one row per rule."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates as G

c = F.col


def decide(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_point_push(spark):
    rows = [
        (False, True, 1.0, 2.0, None), (True, False, 1.0, 2.0, False), (True, False, 1.0, 2.0, None), (True, True, 0.99, 1.0, False),
        (True, True, 0.996, 1.0, None), (True, True, None, 1.0, None), (True, True, float("nan"), 1.0, None),
    ]
    got = decide(spark, "p boolean, m boolean, a double, b double, s boolean", rows, G.point_push(c("p"), c("m"), c("a"), c("b"), c("s")))
    assert got == ["bootstrap", "schema_drift_rejected_sanity", "schema_drift_push_as_candidate", "pushed_to_candidate", "rejected", "rejected", "rejected"]


def test_corridor_push_order(spark):
    rows = [
        (False, True, True, 1.0, 2.0, True, None), (True, True, False, 1.0, 2.0, True, False), (True, False, False, 1.0, 2.0, True, None),
        (True, False, True, 1.0, 2.0, True, False), (True, False, True, 1.0, 2.0, False, True), (True, True, True, 1.0, 2.0, False, None),
        (True, True, True, 1.0, 2.0, True, None), (True, True, True, 2.0, 2.0, True, None),
    ]
    e = G.corridor_push(c("p"), c("m"), c("q"), c("a"), c("b"), c("o"), c("s"))
    got = decide(spark, "p boolean, m boolean, q boolean, a double, b double, o boolean, s boolean", rows, e)
    assert got == [
        "bootstrap", "schema_drift_rejected_sanity", "no_production_quantiles_push_as_candidate", "schema_drift_rejected_sanity",
        "schema_drift_push_as_candidate", "rejected_miscalibrated", "pushed_to_candidate", "rejected",
    ]


@pytest.mark.parametrize("decision,slot", [("bootstrap", "production"), ("pushed_to_candidate", "candidate"), ("rejected", None)])
def test_target_slot(spark, decision, slot):
    assert decide(spark, "d string", [(decision,)], G.target_slot(c("d"))) == [slot]


def test_sanity(spark):
    rows = [(1.0, 0.5, 1.0, 0.5), (1.03, 0.6, 1.0, 0.5), (1.0, 0.4, 1.0, 0.5), (None, 0.5, 1.0, 0.5), (float("nan"), 0.5, 1.0, 0.5)]
    got = decide(spark, "a double, b double, c double, d double", rows, G.point_sanity(c("a"), c("b"), c("c"), c("d")))
    assert got == ["ok", "mae_worse_than_naive", "dir_acc_below_naive", "nan_metric", "nan_metric"]
    rows = [(1.0, 1.0, True), (1.03, 1.0, True), (1.0, 1.0, False), (1.0, 1.0, None), (None, 1.0, True)]
    got = decide(spark, "a double, b double, o boolean", rows, G.quantile_sanity(c("a"), c("b"), c("o")))
    assert got == ["ok", "pinball_worse_than_naive", "coverage_not_calibrated", "coverage_not_calibrated", "nan_metric"]


def test_live_promotion(spark):
    s = "hc boolean, hp boolean, n int, a double, b double, r boolean, m boolean"
    rows = [
        (False, True, 500, 60.0, 50.0, False, False), (True, False, 500, 60.0, 50.0, False, False), (True, True, 500, 60.0, 50.0, False, True),
        (True, True, 99, 60.0, 50.0, False, False), (True, True, 100, None, 50.0, False, False), (True, True, 100, 51.0, 50.0, True, False),
        (True, True, 100, 50.5, 50.0, True, False), (True, True, 100, 50.5, 50.0, False, False),
    ]
    got = decide(spark, s, rows, G.point_promotion(c("hc"), c("hp"), c("n"), c("a"), c("b"), c("r"), c("m")))
    assert got == ["no_candidate", "no_production", G.MANUAL, "insufficient_samples", "no_comparable_metrics", "accuracy_improved", "point_model_rejected", "not_better"]


def test_corridor_promotion_and_verification(spark):
    got = decide(spark, "a double, b double", [(0.1, 0.9), (0.14, 0.9), (None, 0.9), (0.08, 0.92)], G.corridor_verified(c("a"), c("b")))
    assert got == [True, False, False, True]
    s = "hc boolean, hp boolean, n int, q boolean, v boolean, m boolean"
    rows = [(True, True, 1, False, True, True), (True, True, 500, True, True, True), (True, True, 1, True, True, False), (True, True, 500, True, True, False), (True, True, 500, True, False, False)]
    got = decide(spark, s, rows, G.quantile_promotion(c("hc"), c("hp"), c("n"), c("q"), c("v"), c("m")))
    assert got == ["no_new_quantiles", G.MANUAL, "insufficient_samples", "quantile_gain", "quantile_unverified"]


def test_new_scheme(spark):
    s = "hc boolean, hp boolean, l boolean, cs string, ps string, ok boolean, n int"
    rows = [
        (False, True, True, "x", "y", True, 0), (True, False, True, "x", "y", True, 0), (True, True, None, "x", "x", True, 0), (True, True, None, "x", "y", True, 0),
        (True, True, False, "x", "y", True, 0), (True, True, True, None, "y", True, 0), (True, True, True, "x", "y", True, 2), (True, True, True, "x", "y", None, 0),
        (True, True, True, "x", "y", False, 0), (True, True, True, "x", None, True, 0),
    ]
    got = decide(spark, s, rows, G.new_scheme_promotion(c("hc"), c("hp"), c("l"), c("cs"), c("ps"), c("ok"), c("n")))
    assert got == ["no_candidate", "no_production", "schema_unchanged", "label_missing", "not_new_scheme", "schema_unchanged", "candidate_inconsistent", "sanity_missing", "sanity_failed", "promote_new_scheme"]


def test_half_push_keeps_the_other_half(spark):
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("quantile_a"), F.lit("2"))
    d = spark.range(1).select(G.merge_metadata(old, F.create_map(F.lit("quantile_a"), F.lit("9"))).alias("m"))
    r = d.select("m", G.point_half(c("m")).alias("p"), G.quantile_half(c("m")).alias("q")).first()
    assert r.m == {"a": "1", "quantile_a": "9"} and r.p == {"a": "1"} and r.q == {"quantile_a": "9"}
    none = F.lit(None).cast("map<string,string>")
    assert spark.range(1).select(G.merge_metadata(none, F.create_map(F.lit("k"), F.lit("v")))).first()[0] == {"k": "v"}


def test_corridor_needs_a_majority(spark):
    from tidemark.operators.evaluation import corridor_summary

    rows = [
        ("half", 1.0, 0.13, 3.0, 0.5), ("most", 1.0, 0.1, 2.0, 0.92), ("most", 3.0, 0.08, 2.0, 0.5),
        ("none", 1.0, 0.5, 1.0, 0.5), ("unseen", None, None, 2.0, 0.9),
    ]
    d = spark.createDataFrame(rows, "symbol string, pinball_10 double, coverage_10 double, pinball_90 double, coverage_90 double")
    got = {r.symbol: (r.n_cells, r.n_within, r.avg_pinball, r.majority_calibrated) for r in corridor_summary(d, ["symbol"], tolerance=0.05).collect()}
    assert got == {"half": (2, 1, 2.0, False), "most": (4, 3, 2.0, True), "none": (2, 0, 1.0, False), "unseen": (2, 1, 2.0, False)}
    assert corridor_summary(d.limit(0), ["symbol"]).count() == 0


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["slot_audit", "gate_new_scheme"])
def test_slot_listings_are_not_broadcast(spark, name):
    # they are exploded from a table and look as small as that; the default threshold would take them at any size
    from tidemark.plans import gates as PG

    plan = final_plan(getattr(PG, name)(spark, "/root/testdata/sf0.01"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_name_is_missed_once_per_half(spark):
    schema = "symbol string, slot string, has_metadata boolean, feature_columns array<string>, schema_version string, horizons array<long>, model_version string, quantile_levels array<string>, quantile_horizons array<long>, quantile_model_version string, quantile_schema_version string"
    slots = spark.createDataFrame([("s", "candidate", True, ["a"], "x", [1, 2], "v", ["0.1"], [1, 2], "q", "x")], schema)
    listed = spark.createDataFrame([("s", "candidate", "h1.txt"), ("s", "candidate", "h2_q0.1.txt"), ("s", "production", "h2.txt")], "symbol string, slot string, name string")
    got = {r.problem for r in G.slot_problems(slots, listed).collect() if "missing" in r.problem}
    assert got == {"point: h2.txt missing", "quantile: h1_q0.1.txt missing"}
    assert {r.problem for r in G.slot_problems(slots, listed, quantiles=False).collect() if "missing" in r.problem} == {"point: h2.txt missing"}
