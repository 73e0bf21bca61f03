"""Fold metrics, baselines, pooling and comparison tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import metrics as M
from tidemark.operators import ranks as R, splits as S, windows as WN
from tidemark.operators.blocks import from_micros
from tidemark.tables import DAY

Cell = tuple[Mapping[str, object], Mapping[str, Column]]


def stacked(df: DataFrame, groups: Sequence[str], cells: Sequence[Cell]) -> DataFrame:
    """Aggregate many (labels, statistics) cells in one pass and return them in long form.

    The cells are columns of one aggregation, so the rows are not multiplied by horizons or variants
    before the shuffle; only the result is.
    """
    g = df.groupBy(*groups).agg(*[e.alias(f"{s}__{i}") for i, (_, st) in enumerate(cells) for s, e in st.items()])
    parts = [
        F.struct(
            *[F.lit(v).alias(k) for k, v in labels.items()], *[F.col(f"{s}__{i}").alias(s) for s in stats]
        )
        for i, (labels, stats) in enumerate(cells)
    ]
    return g.select(*groups, F.explode(F.array(*parts)).alias("_c")).select(*groups, "_c.*")


def sign_counts(y: Column) -> dict[str, Column]:
    return {
        "neg": F.count(F.when(y < 0, 1)),
        "zero": F.count(F.when(y == 0, 1)),
        "pos": F.count(F.when(y > 0, 1)),
    }


def majority_hits(p: str = "") -> Column:
    """Test hits of the train window's most frequent sign; equal counts go to the smaller sign."""
    neg, zero, pos = (F.col(f"train_{x}") for x in ("neg", "zero", "pos"))
    return (
        F.when((neg >= zero) & (neg >= pos), F.col("neg")).when(zero >= pos, F.col("zero")).otherwise(F.col("pos"))
    )


def naive_folds(
    targets: DataFrame, folds: DataFrame, horizons: Sequence[int], min_train_us: int, test_us: int
) -> DataFrame:
    """Per fold and horizon: error of "no change" and accuracy of the train window's majority sign.

    ``targets`` carries ``pos``. Train counts are running sums of slices, so every row is read once
    whatever the number of folds.
    """
    cells = [({"horizon": h}, sign_counts(F.col(f"r_{h}"))) for h in horizons]
    sl = stacked(S.with_train_slice(targets, folds), [S.KEY, "slice"], cells)
    grid = folds.select(S.KEY, F.col("fold").alias("slice")).withColumn(
        "horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))
    )
    train = grid.join(sl, [S.KEY, "slice", "horizon"], "left").fillna(0, ["neg", "zero", "pos"])
    train = S.running(train, [S.KEY, "horizon"], "slice", ["neg", "zero", "pos"])
    train = train.select(
        S.KEY, F.col("slice").alias("fold"), "horizon", *[F.col(c).alias(f"train_{c}") for c in ("neg", "zero", "pos")]
    )
    cells = [
        (
            {"horizon": h},
            {"mae": M.naive_mae(F.col(f"r_{h}")), "n_test": F.count(f"r_{h}"), **sign_counts(F.col(f"r_{h}"))},
        )
        for h in horizons
    ]
    test = stacked(
        S.with_test_fold(targets, folds, min_train_us, test_us), [S.KEY, "fold", "test_start", "test_end"], cells
    )
    n_train = F.col("train_neg") + F.col("train_zero") + F.col("train_pos")
    return test.join(train, [S.KEY, "fold", "horizon"]).select(
        S.KEY,
        "fold",
        from_micros("test_start").alias("test_start"),
        from_micros("test_end").alias("test_end"),
        "horizon",
        "mae",
        (majority_hits() / F.nullif(F.col("n_test"), F.lit(0))).alias("directional_accuracy"),
        n_train.alias("n_train"),
        "n_test",
    )


def pool(fold_results: DataFrame, metrics: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Fold metrics weighted by each fold's ``n_test``; equal to the metric over all rows at once."""
    n = F.sum("n_test")
    return (
        fold_results.filter("n_test > 0")
        .groupBy(*groups)
        .agg(
            *[(F.sum(F.col(m) * F.col("n_test")) / n).alias(m) for m in metrics],
            F.countDistinct("fold").alias("n_folds"),
            n.alias("n_test_total"),
        )
    )


def point_cells(variants: Mapping[str, Callable[[int], Column]], horizons: Sequence[int]) -> list[Cell]:
    """MAE, accuracy and pair count of every variant and horizon."""
    out = []
    for v, pred in variants.items():
        for h in horizons:
            a, p = F.col(f"r_{h}"), pred(h)
            out.append(
                (
                    {"variant": v, "horizon": h},
                    {
                        "mae": M.mae(a, p),
                        "directional_accuracy": M.directional_accuracy(a, p),
                        "n_test": M.n_pairs(a, p),
                    },
                )
            )
    return out


def quantile_cells(
    variants: Mapping[str, Callable[[int, float], Column]], horizons: Sequence[int], quantiles: Sequence[float]
) -> list[Cell]:
    out = []
    for v, pred in variants.items():
        for h in horizons:
            for q in quantiles:
                a, p = F.col(f"r_{h}"), pred(h, q)
                out.append(
                    (
                        {"variant": v, "horizon": h, "quantile": q},
                        {"pinball_loss": M.pinball(a, p, q), "coverage": M.coverage(a, p), "n_test": M.n_pairs(a, p)},
                    )
                )
    return out


def daily_cells(variants: Mapping[str, Callable[[int], Column]], horizons: Sequence[int]) -> list[Cell]:
    """Sums from which pooled accuracy and error of any set of days can be rebuilt exactly."""
    out = []
    for v, pred in variants.items():
        for h in horizons:
            a, p = F.col(f"r_{h}"), pred(h)
            ok = M.both(a, p)
            out.append(
                (
                    {"variant": v, "horizon": h},
                    {
                        "n": M.n_pairs(a, p),
                        "n_dir_correct": F.coalesce(F.sum(M.hit(a, p)), F.lit(0)),
                        "sum_abs_err": F.sum(F.when(ok, F.abs(a - p))),
                        "sum_abs_actual": F.sum(F.when(ok, F.abs(a))),
                    },
                )
            )
    return out


def daily_stats(test_rows: DataFrame, variants, horizons: Sequence[int], extra: Sequence[str] = ()) -> DataFrame:
    """Per (symbol, variant, horizon, day) sufficient statistics of the test rows."""
    day = from_micros(F.col("t") - F.pmod(F.col("t"), F.lit(DAY)))
    d = test_rows.withColumn("day", day)
    return stacked(d, [S.KEY, *extra, "day"], daily_cells(variants, horizons)).filter("n > 0")


def side_by_side(pooled: DataFrame, keys: Sequence[str], metrics: Sequence[str], a: str, b: str) -> DataFrame:
    """Both variants' metrics in one row with b - a; one aggregation instead of a self-join."""
    def pick(m, v):
        return F.max(F.when(F.col("variant") == v, F.col(m)))

    g = pooled.groupBy(*keys).agg(*[pick(m, v).alias(f"{m}_{v}") for m in metrics for v in (a, b)])
    return g.filter(" and ".join(f"{m}_{v} is not null" for m in metrics for v in (a, b))).withColumns(
        {f"{m}_delta": F.col(f"{m}_{b}") - F.col(f"{m}_{a}") for m in metrics}
    )


def versus_level(table: DataFrame, keys: Sequence[str], condition: str, level: str, metric: str) -> DataFrame:
    """Difference and ratio of every condition to one reference level of the same key."""
    w = W.partitionBy(*keys)
    ref = F.max(F.when(F.col(condition) == level, F.col(metric))).over(w)
    return table.withColumns({f"{metric}_delta": F.col(metric) - ref, f"{metric}_pct": (F.col(metric) - ref) / ref})


def fold_overall(quantile_folds: DataFrame) -> DataFrame:
    """One weighted pinball loss per (symbol, variant, fold) over all horizons and quantiles."""
    n = F.col("n_test")
    return quantile_folds.groupBy(S.KEY, "variant", "fold").agg(
        (F.sum(F.col("pinball_loss") * n) / F.sum(n)).alias("overall_pinball_loss")
    )


def coverage_calibration(quantile_folds: DataFrame, quantiles=(0.1, 0.9), tolerance: float = 0.03) -> DataFrame:
    """Folds whose weighted coverage is within the tolerance of the nominal level."""
    n = F.col("n_test")
    per = (
        quantile_folds.filter(F.col("quantile").isin(*quantiles))
        .groupBy(S.KEY, "variant", "quantile", "fold")
        .agg((F.sum(F.col("coverage") * n) / F.sum(n)).alias("coverage"))
    )
    ok = F.abs(F.col("coverage") - F.col("quantile")) <= tolerance
    return per.groupBy(S.KEY, "variant", "quantile").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.count(F.when(ok, 1)).alias("folds_within_tolerance"),
        F.avg("coverage").alias("mean_coverage"),
    )


def corridor_summary(cells: DataFrame, by: list[str], quantiles=(0.1, 0.9), tolerance: float = 0.03) -> DataFrame:
    """(by, n_cells, n_within, avg_pinball, majority_calibrated) over the cells of a held-out evaluation.

    A cell is one quantile of one row of ``cells``, which holds pinball_10, coverage_10 and so on. The corridor is
    calibrated where more than half of the cells cover their nominal share within the tolerance; a cell without
    coverage counts as outside, a half is no majority.
    """
    parts = [
        F.struct(F.col(f"pinball_{round(q * 100)}").alias("pinball"), (F.abs(F.col(f"coverage_{round(q * 100)}") - q) <= tolerance).alias("within"))
        for q in quantiles
    ]
    g = cells.select(*by, F.inline(F.array(*parts))).groupBy(*by)
    out = g.agg(F.count(F.lit(1)).alias("n_cells"), F.count(F.when(F.col("within"), 1)).alias("n_within"), F.avg("pinball").alias("avg_pinball"))
    return out.withColumn("majority_calibrated", F.col("n_within") * 2 > F.col("n_cells"))


def regime_edges(rows: DataFrame, folds: DataFrame, axis: str) -> DataFrame:
    """Terciles of the axis over every fold's train rows."""
    g = WN.grid(rows.select(S.KEY, "pos", axis), folds, [S.KEY], axis, "pos", "train_pos", "train_end_pos")
    return WN.quantiles(g, [1 / 3, 2 / 3], out="edge").select(
        S.KEY, "fold", F.col("edge1").alias("edge_lo"), F.col("edge2").alias("edge_hi")
    )


def regime_folds(test_rows: DataFrame, edges: DataFrame, axis: str, pred, horizons: Sequence[int]) -> DataFrame:
    """Error sums per (fold, bucket, horizon), buckets cut at the train terciles of the axis."""
    d = test_rows.join(edges, [S.KEY, "fold"]).filter(F.col(axis).isNotNull())
    b = R.left_closed(F.col(axis), [F.col("edge_lo"), F.col("edge_hi")])
    d = d.withColumn("bucket", F.element_at(F.array(*[F.lit(x) for x in ("lo", "mid", "hi")]), b + 1))
    out = stacked(d, [S.KEY, "fold", "bucket"], daily_cells({"model": pred}, horizons))
    return out.filter("n > 0").withColumn("axis", F.lit(axis)).drop("variant")


def regime_pooled(fold_rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    n = F.sum("n")
    return (
        fold_rows.groupBy(*groups)
        .agg(
            n.alias("n"),
            F.countDistinct("fold").alias("n_folds"),
            (F.sum("sum_abs_err") / n).alias("mae_model"),
            (F.sum("sum_abs_actual") / n).alias("mae_naive"),
            (F.sum("n_dir_correct") / n).alias("dir_acc"),
        )
        .withColumn("skill", 1 - F.col("mae_model") / F.nullif(F.col("mae_naive"), F.lit(0.0)))
    )


def regime_pivot(pooled: DataFrame) -> DataFrame:
    """Horizon rows, bucket columns for skill and accuracy, and hi minus lo of both."""
    p = (
        pooled.groupBy(S.KEY, "axis", "horizon")
        .pivot("bucket", ["lo", "mid", "hi"])
        .agg(F.max("skill").alias("skill"), F.max("dir_acc").alias("da"))
    )
    return p.withColumns(
        {"skill_hi_minus_lo": F.col("hi_skill") - F.col("lo_skill"), "da_hi_minus_lo": F.col("hi_da") - F.col("lo_da")}
    )


def naive_within_folds(model: DataFrame, weekly: DataFrame) -> DataFrame:
    """Model folds with the weighted naive metrics of the short folds that start inside them.

    Equi-join on (symbol, horizon) with a time residual; the short folds of one symbol and horizon
    are as many as the test windows in the data's time span.
    """
    wk = weekly.select(S.KEY, "horizon", F.col("test_start").alias("w_start"), F.col("mae").alias("w_mae"),
                       F.col("directional_accuracy").alias("w_da"), F.col("n_test").alias("w_n"))
    inside = (F.col("w_start") >= F.col("test_start")) & (F.col("w_start") < F.col("test_end"))
    keys = [S.KEY, "fold", "horizon", "test_start", "n_test", "mae", "directional_accuracy"]
    return (
        model.join(wk, [S.KEY, "horizon"])
        .filter(inside)
        .groupBy(*keys)
        .agg(
            (F.sum(F.col("w_mae") * F.col("w_n")) / F.sum("w_n")).alias("naive_mae"),
            (F.sum(F.col("w_da") * F.col("w_n")) / F.sum("w_n")).alias("naive_da"),
            F.count(F.lit(1)).alias("n_weekly"),
        )
    )
