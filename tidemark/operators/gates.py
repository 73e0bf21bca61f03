"""Decision tables as column expressions: push gates, sanity, promotion, slot audit, pass bars.

Every function takes columns and returns a column, so one select decides for all symbols at once. A
missing metric (NULL or NaN) never passes a comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import evaluation as E

# Thresholds and decision labels.
MIN_IMPROVEMENT = 0.005
MAX_MAE_RATIO = 1.02
MIN_DA_EDGE = 0.0
MAX_PINBALL_RATIO = 1.02
CORRIDOR = (0.1, 0.9)
TOLERANCE = 0.03
MIN_SAMPLES = 100
MIN_GAIN_PP = 1.0
MANUAL = "new_scheme_manual_promotion_required"


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def improved(candidate: Column, production: Column, bar: float) -> Column:
    gain = (production - candidate) / F.nullif(production, F.lit(0.0))
    return F.coalesce(~missing(candidate) & ~missing(production) & (gain >= bar), F.lit(False))


def is_false(c: Column) -> Column:
    return F.coalesce(~c, F.lit(False))


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def point_push(has_production, schema_matches, candidate, production, sanity, bar: float = MIN_IMPROVEMENT) -> Column:
    return (
        F.when(~has_production, "bootstrap")
        .when(~schema_matches & is_false(sanity), "schema_drift_rejected_sanity")
        .when(~schema_matches, "schema_drift_push_as_candidate")
        .when(improved(candidate, production, bar), "pushed_to_candidate")
        .otherwise("rejected")
    )


def corridor_push(
    has_production, schema_matches, has_quantiles, candidate, production, coverage_ok, sanity, bar: float = MIN_IMPROVEMENT
) -> Column:
    return (
        F.when(~has_production, "bootstrap")
        .when(~has_quantiles & is_false(sanity), "schema_drift_rejected_sanity")
        .when(~has_quantiles, "no_production_quantiles_push_as_candidate")
        .when(~schema_matches & is_false(sanity), "schema_drift_rejected_sanity")
        .when(~schema_matches, "schema_drift_push_as_candidate")
        .when(~coverage_ok, "rejected_miscalibrated")
        .when(improved(candidate, production, bar), "pushed_to_candidate")
        .otherwise("rejected")
    )


def target_slot(decision: Column) -> Column:
    """Slot a push decision writes to; NULL when nothing is pushed."""
    to_candidate = decision.isin(
        "schema_drift_push_as_candidate", "no_production_quantiles_push_as_candidate", "pushed_to_candidate"
    )
    return F.when(decision == "bootstrap", "production").when(to_candidate, "candidate")


def point_sanity(mae, accuracy, naive_mae, naive_accuracy, ratio: float = MAX_MAE_RATIO, edge: float = MIN_DA_EDGE) -> Column:
    """'ok' or the first bar a candidate misses against the naive baseline."""
    gone = missing(mae) | missing(accuracy) | missing(naive_mae) | missing(naive_accuracy)
    return (
        F.when(gone, "nan_metric")
        .when(mae > naive_mae * ratio, "mae_worse_than_naive")
        .when(accuracy < naive_accuracy + edge, "dir_acc_below_naive")
        .otherwise("ok")
    )


def quantile_sanity(pinball, naive_pinball, coverage_ok, ratio: float = MAX_PINBALL_RATIO) -> Column:
    return (
        F.when(missing(pinball) | missing(naive_pinball), "nan_metric")
        .when(~is_true(coverage_ok), "coverage_not_calibrated")
        .when(pinball > naive_pinball * ratio, "pinball_worse_than_naive")
        .otherwise("ok")
    )


def corridor_verified(low: Column, high: Column, levels=CORRIDOR, tolerance: float = TOLERANCE) -> Column:
    """Both live tail coverages near their levels; a missing coverage never verifies."""
    ok = (F.abs(low - levels[0]) <= tolerance) & (F.abs(high - levels[1]) <= tolerance)
    return F.coalesce(ok, F.lit(False))


def point_promotion(
    has_candidate, has_production, n, candidate_acc, production_acc, offline_rejected, manual,
    min_samples: int = MIN_SAMPLES, gain_pp: float = MIN_GAIN_PP,
) -> Column:
    """A live gain that clears the bar wins over an old offline rejection; else the rejection names the reason."""
    return (
        F.when(~has_candidate, "no_candidate")
        .when(~has_production, "no_production")
        .when(manual, MANUAL)
        .when(F.coalesce(n, F.lit(0)) < min_samples, "insufficient_samples")
        .when(candidate_acc.isNull() | production_acc.isNull(), "no_comparable_metrics")
        .when(candidate_acc - production_acc >= gain_pp, "accuracy_improved")
        .when(offline_rejected, "point_model_rejected")
        .otherwise("not_better")
    )


def quantile_promotion(has_candidate, has_production, n, new_quantiles, verified, manual, min_samples: int = MIN_SAMPLES) -> Column:
    return (
        F.when(~has_candidate, "no_candidate")
        .when(~has_production, "no_production")
        .when(~new_quantiles, "no_new_quantiles")
        .when(manual, MANUAL)
        .when(F.coalesce(n, F.lit(0)) < min_samples, "insufficient_samples")
        .when(verified, "quantile_gain")
        .otherwise("quantile_unverified")
    )


def new_scheme_promotion(
    has_candidate, has_production, label, candidate_schema, production_schema, sanity, n_problems, skip_sanity: bool = False
) -> Column:
    """One half (point or corridor) of a candidate with a new feature schema."""
    same = candidate_schema.isNotNull() & candidate_schema.eqNullSafe(production_schema)
    d = (
        F.when(~has_candidate, "no_candidate")
        .when(~has_production, "no_production")
        .when(label.isNull() & same, "schema_unchanged")
        .when(label.isNull(), "label_missing")
        .when(~label, "not_new_scheme")
        .when(candidate_schema.isNull() | same, "schema_unchanged")
        .when(n_problems > 0, "candidate_inconsistent")
    )
    if not skip_sanity:
        d = d.when(sanity.isNull(), "sanity_missing")
    return d.when(is_false(sanity), "sanity_failed").otherwise("promote_new_scheme")


def promotes(decision: Column) -> Column:
    return decision.isin("accuracy_improved", "quantile_gain", "promote_new_scheme")


def legacy_label(has_half, label, candidate_schema, production_schema) -> Column:
    """True where a missing new-scheme label should be filled in: the schemas differ."""
    differ = candidate_schema.isNotNull() & ~candidate_schema.eqNullSafe(production_schema)
    return F.when(has_half & label.isNull() & differ, F.lit(True)).otherwise(label)


def merge_metadata(existing: Column, updates: Column) -> Column:
    """Shallow merge of two string maps, the update's keys win, a missing map is empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(existing, empty), F.coalesce(updates, empty)
    keep = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(keep, new)


def point_half(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, _: ~k.startswith("quantile_"))


def quantile_half(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, _: k.startswith("quantile_"))


def slot_problems(slots: DataFrame, files: DataFrame, point: bool = True, quantiles: bool = True) -> DataFrame:
    """One row per problem of a slot: (symbol, slot, problem).

    ``slots`` has feature_columns, schema_version, horizons, model_version, quantile_levels (strings),
    quantile_horizons, quantile_model_version, quantile_schema_version and ``has_metadata``;
    ``files`` lists (symbol, slot, name). Expected files are an anti-join against the listing, a sort-merge join whatever
    the planner expects: a listing made by exploding looks as small as the table it comes from, and would be broadcast.
    """
    from tidemark.functions.text import schema_version

    key = ["symbol", "slot"]
    live = slots.filter("has_metadata")
    out = slots.filter("not has_metadata").select(*key, F.lit("metadata.json missing").alias("problem"))

    def rows(where: Column, text: Column) -> DataFrame:
        return live.filter(where).select(*key, text.alias("problem"))

    def wanted(expected: DataFrame, prefix: str, name: Column) -> DataFrame:
        return expected.select(*key, F.lit(prefix).alias("half"), name.alias("name"))

    needs = []
    has_features = F.coalesce(F.size("feature_columns") > 0, F.lit(False))
    has_levels = F.coalesce(F.size("quantile_levels") > 0, F.lit(False))
    want = schema_version(F.col("feature_columns"))
    if point:
        off = has_features & ~F.col("schema_version").eqNullSafe(want)
        no_h = ~F.coalesce(F.size("horizons") > 0, F.lit(False))
        out = (
            out.unionByName(rows(~has_features, F.lit("point: feature_columns missing/empty")))
            .unionByName(rows(off, F.lit("point: schema_version is not the hash of feature_columns")))
            .unionByName(rows(no_h, F.lit("point: horizons missing/empty")))
            .unionByName(rows(F.coalesce("model_version", F.lit("")) == "", F.lit("point: model_version missing")))
        )
        expected = live.select(*key, F.explode("horizons").alias("h"))
        needs.append(wanted(expected, "point: ", F.format_string("h%d.txt", "h")))
    if quantiles:
        q = live.filter(has_levels)
        expected = q.select(*key, F.explode("quantile_horizons").alias("h"), "quantile_levels").select(
            *key, "h", F.explode("quantile_levels").alias("q")
        )
        needs.append(wanted(expected, "quantile: ", F.format_string("h%d_q%s.txt", "h", "q")))
        no_v = has_levels & (F.coalesce("quantile_model_version", F.lit("")) == "")
        out = out.unionByName(rows(no_v, F.lit("quantile: quantile_model_version missing")))
        if point:
            mixed = has_levels & ~F.col("quantile_schema_version").eqNullSafe(F.col("schema_version"))
            out = out.unionByName(rows(mixed, F.lit("mixed schema: point and corridor differ")))
    if needs:
        listed = files.select(*key, "name").hint("merge")
        gone = reduce(DataFrame.unionByName, needs).join(listed, [*key, "name"], "left_anti")
        out = out.unionByName(gone.select(*key, F.concat("half", "name", F.lit(" missing")).alias("problem")))
    return out


def live_compare(resolved: DataFrame, windows_us: dict[str, int | None], now: Column) -> DataFrame:
    """n, accuracy and tail coverages per (symbol, slot, version, window) of resolved predictions.

    A prediction counts in every window that holds it, so windows are flags on one scan.
    """
    from tidemark.functions import metrics as M

    cells = []
    for name, width in windows_us.items():
        inside = F.lit(True) if width is None else F.col("resolved_t") > now - F.lit(width)
        a, p = F.when(inside, F.col("actual")), F.when(inside, F.col("predicted"))
        cells.append((
            {"window": name},
            {
                "n": M.n_pairs(a, p), "directional_accuracy": M.directional_accuracy(a, p) * 100,
                "q10_coverage": M.coverage(a, F.when(inside, F.col("q10"))), "q90_coverage": M.coverage(a, F.when(inside, F.col("q90"))),
            },
        ))
    return E.stacked(resolved, ["symbol", "slot", "version"], cells).filter("n > 0")


def corridor_bar(quantile_folds: DataFrame, a: str, b: str, min_gain: float = 0.01, alpha: float = 0.05) -> DataFrame:
    """Pre-registered corridor verdict per symbol: gain, significance and majority coverage."""
    from tidemark.operators import stats as ST

    overall = E.fold_overall(quantile_folds)
    test = ST.paired_test(ST.paired_deltas(overall, ["symbol"], "overall_pinball_loss", a, b))
    base = overall.filter(F.col("variant") == a).groupBy("symbol").agg(F.avg("overall_pinball_loss").alias("base"))
    cov = E.coverage_calibration(quantile_folds.filter(F.col("variant") == b)).groupBy("symbol").agg(
        F.bool_and(F.col("folds_within_tolerance") > F.col("n_folds") / 2).alias("passes_coverage")
    )
    gain = -F.col("mean_delta") / F.col("base")
    d = test.join(base, "symbol").join(cov, "symbol").withColumns(
        {
            "relative_gain": gain,
            "passes_gain": gain >= min_gain,
            "passes_significance": (F.col("p_value") < alpha) & (F.col("mean_delta") < 0),
        }
    )
    return d.withColumn("passes", F.col("passes_gain") & F.col("passes_significance") & F.col("passes_coverage"))


def direction_bar(boot: DataFrame) -> DataFrame:
    """Pooled directional gain counts when its whole interval lies above zero."""
    return boot.filter("horizon = 'pooled'").withColumn("passes", F.col("ci_lo_pp") > 0)


def mae_bar(versus: DataFrame, bar: float = 0.005) -> DataFrame:
    """Conditions whose pooled error is at least ``bar`` below the reference level."""
    return versus.withColumn("passes", F.col("mae_pct") <= -bar)
