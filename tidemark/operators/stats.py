"""Regression, rank and paired tests: moments on Spark, tails on the few result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dist import chi2_p_value, t_p_value, t_upper_quantile
from tidemark.operators import ranks as R
from tidemark.operators.blocks import BLOCK_ROWS, block_window, with_halo, with_position
from tidemark.session import settle


def pairs(df: DataFrame, keys: Sequence[str], x: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, *keep, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )


def ols_hac(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, lags: int, block_us: int) -> DataFrame:
    """Slope of y on x with a Newey-West t (Bartlett weights), R2 and n, per key.

    Lags count rows after NULL pairs are gone. With u = (e, x e), the Bartlett sum over lags is
    sum_t u_t * L_t' with L_t = sum_l (1 - l/(lags+1)) u_(t-l); L_t comes from two frame sums per
    component (plain and position-weighted), so the pass is linear in the rows.
    """
    d = with_position(pairs(df, keys, x, y, [order]), keys, order, block_us)
    # Centred sums: the normal equations of a centred x are diagonal and well conditioned.
    mom = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.regr_slope("y", "x").alias("slope"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"),
    )
    mom = settle(mom)
    e = F.col("y") - F.col("my") - F.col("slope") * (F.col("x") - F.col("mx"))
    d = with_halo(d.join(mom, [*keys]).withColumn("e", e), "pos", lags)
    first = F.col("blk") * BLOCK_ROWS - lags
    d = d.withColumns({"xe": F.col("x") * F.col("e"), "i": (F.col("pos") - first).cast("double")})
    f = block_window(keys, "pos").rowsBetween(-lags, -1)

    def lagged(c: Column) -> Column:
        a = F.coalesce(F.sum(c).over(f), F.lit(0.0))
        b = F.coalesce(F.sum(c * F.col("i")).over(f), F.lit(0.0))
        # 1 - l/(lags+1) with l = i_t - i_j
        return a * (1 - F.col("i") / (lags + 1)) + b / (lags + 1)

    e_, xe = F.col("e"), F.col("xe")
    d = d.withColumns({"l0": lagged(e_), "l1": lagged(xe)}).filter("own")
    l0, l1 = F.col("l0"), F.col("l1")
    s = d.groupBy(*keys, "n", "mx", "slope", "sxx", "syy").agg(
        F.sum(e_ * e_ + 2 * e_ * l0).alias("s00"),
        F.sum(e_ * xe + e_ * l1 + xe * l0).alias("s01"),
        F.sum(xe * xe + 2 * xe * l1).alias("s11"),
        F.sum(e_ * e_).alias("sse"),
    )
    # Row of (X'X)^-1 for the slope is (-mx, 1) / sxx.
    var = (F.col("mx") ** 2 * F.col("s00") - 2 * F.col("mx") * F.col("s01") + F.col("s11")) / F.col("sxx") ** 2
    return s.select(
        *keys, "slope", F.when(var > 0, F.col("slope") / F.sqrt(var)).alias("t_hac"),
        (1 - F.col("sse") / F.col("syy")).alias("r2"), "n",
    )


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, standard error, t, r and n of a simple regression."""
    g = pairs(df, keys, x, y).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.corr("x", "y").alias("r"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"),
    )
    se = F.sqrt((1 - F.col("r") ** 2) * F.col("syy") / F.col("sxx") / (F.col("n") - 2))
    g = g.withColumn("stderr", F.when(F.col("n") > 2, se))
    return g.withColumn("t", F.col("slope") / F.nullif(F.col("stderr"), F.lit(0.0))).drop("sxx", "syy")


def with_t_p(df: DataFrame, t: str = "t", n: str = "n", used: int = 2, out: str = "p_value") -> DataFrame:
    return df.withColumn(out, t_p_value(F.col(t), (F.col(n) - used).cast("double")))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with averaged ties, and the t that gives its p-value."""
    c = pairs(df, keys, x, y).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("m"))
    rows = pairs(df, keys, x, y)
    rx = R.ordered_counts(rows, keys, "x").select(*keys, "x", R.average_rank().alias("rx"))
    ry = R.ordered_counts(rows, keys, "y").select(*keys, "y", R.average_rank().alias("ry"))
    d = c.join(rx, [*keys, "x"]).join(ry, [*keys, "y"])
    m = F.col("m")
    # Weighted moments around the common mean rank (n + 1) / 2.
    size = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    d = d.join(size, [*keys])
    mid = (F.col("n") + 1) / F.lit(2.0)
    dx, dy = F.col("rx") - mid, F.col("ry") - mid
    g = d.groupBy(*keys, "n").agg(
        F.sum(m * dx * dy).alias("sxy"), F.sum(m * dx * dx).alias("sxx"), F.sum(m * dy * dy).alias("syy")
    )
    rho = F.col("sxy") / F.nullif(F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0))
    g = g.select(*keys, "n", rho.alias("rho"))
    return g.withColumn(
        "t", F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") ** 2, F.lit(0.0)))
    )


def kruskal(df: DataFrame, keys: Sequence[str], value: str, group: str) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H and its degrees of freedom."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(
        *keys, F.col(value).alias("v"), F.col(group).alias("g")
    )
    ranks = R.ordered_counts(rows, keys, "v")
    per = rows.groupBy(*keys, "v", "g").agg(F.count(F.lit(1)).alias("m"))
    sums = (
        per.join(ranks.select(*keys, "v", R.average_rank().alias("rk")), [*keys, "v"])
        .groupBy(*keys, "g")
        .agg(F.sum(F.col("m") * F.col("rk")).alias("rs"), F.sum("m").alias("ng"))
    )
    n = F.col("n")
    tot = ranks.groupBy(*keys).agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties")
    )
    h = sums.join(tot, [*keys]).groupBy(*keys, "n", "ties").agg(
        F.sum(F.col("rs") ** 2 / F.col("ng")).alias("q"), F.count(F.lit(1)).alias("_groups")
    )
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return h.select(
        *keys, (raw / F.nullif(1 - F.col("ties") / (n**3 - n), F.lit(0.0))).alias("h"),
        (F.col("_groups") - 1).alias("dof"), n.cast("long").alias("n"),
    )


def with_chi2_p(df: DataFrame, h: str = "h", dof: str = "dof", out: str = "p_value") -> DataFrame:
    return df.withColumn(out, chi2_p_value(F.col(h), F.col(dof).cast("double")))


def paired_deltas(fold_values: DataFrame, keys: Sequence[str], metric: str, a: str, b: str) -> DataFrame:
    """Mean, deviation and t of b - a over folds, and the folds where b is lower."""
    def pick(v):
        return F.max(F.when(F.col("variant") == v, F.col(metric)))

    wide = fold_values.groupBy(*keys, "fold").agg((pick(b) - pick(a)).alias("d")).filter("d is not null")
    g = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("std_delta"),
        F.count(F.when(F.col("d") < 0, 1)).alias("folds_favoring"),
    )
    se = F.col("std_delta") / F.sqrt("n_folds")
    return g.withColumn("t_stat", F.col("mean_delta") / F.nullif(se, F.lit(0.0)))


def paired_test(deltas: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """p-value, smallest detectable effect and t-interval added to ``paired_deltas``."""
    dof = (F.col("n_folds") - 1).cast("double")
    crit = t_upper_quantile(F.lit(1 - alpha / 2), dof)
    se = F.col("std_delta") / F.sqrt("n_folds")
    d = deltas.withColumns(
        {"p_value": t_p_value(F.col("t_stat"), dof), "_c": crit, "_b": t_upper_quantile(F.lit(power), dof)}
    )
    return d.withColumns(
        {
            "min_detectable": (F.col("_c") + F.col("_b")) * se,
            "ci_lo": F.col("mean_delta") - F.col("_c") * se,
            "ci_hi": F.col("mean_delta") + F.col("_c") * se,
        }
    ).drop("_c", "_b")


def residualise(df: DataFrame, keys: Sequence[str], y: str, control: str, out: str) -> DataFrame:
    """y minus its straight-line fit on the control."""
    # A constant control leaves the fit at the mean.
    fit = settle(pairs(df, keys, control, y).groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("_b"), F.regr_intercept("y", "x").alias("_a"), F.avg("y").alias("_m")
    ))
    line = F.coalesce(F.col("_a") + F.col("_b") * F.col(control), F.col("_m"))
    return df.join(fit, [*keys]).withColumn(out, F.col(y) - line).drop("_a", "_b", "_m")


def profile(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.stddev_samp(x).alias("std_x"),
        F.avg(y).alias("mean_y"), F.corr(x, y).alias("corr_xy"),
    )


def coverage_summary(df: DataFrame, keys: Sequence[str], feature: str) -> DataFrame:
    """Share of rows with the feature, its range, and its exact median."""
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(feature).isNotNull().cast("int")).alias("coverage"),
        F.min(feature).alias("min_value"), F.max(feature).alias("max_value"),
    )
    med = R.exact_quantiles(df, keys, feature, [0.5], out="median_").select(*keys, F.col("median_1").alias("median_value"))
    return g.join(med, [*keys], "left")
