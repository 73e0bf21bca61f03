"""Marginal screens: buckets, categories, conditional probabilities and constant baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import metrics as M
from tidemark.operators import evaluation as E, ranks as R, splits as S, windows as WN
from tidemark.session import settle

KEY = S.KEY


def long_targets(rows: DataFrame, horizons: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """One row per horizon with a non-NULL target; for order statistics, which need the rows."""
    parts = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"r_{h}").alias("r")) for h in horizons])
    return rows.select(*keep, F.explode(parts).alias("_p")).select(*keep, "_p.*").filter("r is not null")


def constant_quantiles(parts: DataFrame, horizons: Sequence[int], quantiles: Sequence[float]) -> DataFrame:
    """Pinball loss on part 'holdout' of the constant train quantile, per horizon and level."""
    d = long_targets(parts, horizons, [KEY, "part"])
    consts = settle(R.exact_quantiles(d.filter("part = 'train'"), [KEY, "horizon"], "r", quantiles).drop("n_rows"))
    j = d.filter("part = 'holdout'").join(consts, [KEY, "horizon"])
    cells = [
        (
            {"quantile": q},
            {
                "constant": F.first(f"q{i}"),
                "pinball_loss": M.pinball(F.col("r"), F.col(f"q{i}"), q),
                "n": F.count("r"),
            },
        )
        for i, q in enumerate(quantiles, 1)
    ]
    return E.stacked(j, [KEY, "horizon"], cells)


def naive_point(parts: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Average naive error and majority accuracy over the horizons that have holdout targets."""
    train, test = F.col("part") == "train", F.col("part") == "holdout"
    cells = []
    for h in horizons:
        y = F.col(f"r_{h}")
        tr = {f"train_{k}": v for k, v in E.sign_counts(F.when(train, y)).items()}
        te = E.sign_counts(F.when(test, y))
        n = F.count(F.when(test, y))
        cells.append(({"horizon": h}, {"mae": M.naive_mae(F.when(test, y)), "n": n, **tr, **te}))
    d = E.stacked(parts, [KEY], cells).filter("n > 0")
    return d.groupBy(KEY).agg(
        F.avg("mae").alias("avg_mae"),
        F.avg(E.majority_hits() / F.col("n")).alias("avg_dir_acc"),
        F.count(F.lit(1)).alias("n_horizons"),
    )


def bucketed(df: DataFrame, keys: Sequence[str], by: str, q: int) -> DataFrame:
    """Rows with ``bucket`` 0.. cut at the exact q-quantiles of ``by``: right-closed, equal edges merged."""
    probs = [i / q for i in range(q + 1)]
    edges = settle(R.exact_quantiles(df, keys, by, probs, out="_e").drop("n_rows"))
    cols = [F.col(f"_e{i}") for i in range(1, q + 2)]
    return df.join(edges, [*keys]).withColumn("bucket", R.right_closed(F.col(by), cols)).drop(
        *[f"_e{i}" for i in range(1, q + 2)]
    )


def bucket_table(df: DataFrame, keys: Sequence[str], value: str, by: str, q: int) -> DataFrame:
    """Count, mean and sample deviation of ``value`` per quantile bucket of ``by``."""
    d = bucketed(df.filter(F.col(value).isNotNull() & F.col(by).isNotNull()), keys, by, q)
    return d.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def bucket_spread(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the top bucket minus mean of the bottom one, in basis points."""
    return table.groupBy(*keys).agg(
        ((F.max_by("mean", "bucket") - F.min_by("mean", "bucket")) * 1e4).alias("spread_bps"),
        F.count(F.lit(1)).alias("n_buckets"),
    )


def category_table(df: DataFrame, keys: Sequence[str], value: str, category: str, min_count: int = 0) -> DataFrame:
    d = df.filter(F.col(value).isNotNull())
    g = d.groupBy(*keys, category).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    return g.withColumn("testable", F.col("n") >= min_count)


def magnitude_table(df: DataFrame, keys: Sequence[str], value: str, magnitude: str) -> DataFrame:
    """Quartiles of a positive magnitude next to the rows without any, in fixed order."""
    names = ["q1_low", "q2", "q3", "q4_high"]
    order = {"no_recent_news": 0, **{n: i for i, n in enumerate(names, 1)}}
    d = df.filter(F.col(value).isNotNull())
    pos = bucketed(d.filter(F.col(magnitude) > 0), keys, magnitude, 4).withColumn(
        "bucket", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("bucket") + 1)
    )
    none = d.filter(~(F.col(magnitude) > 0)).withColumn("bucket", F.lit("no_recent_news"))
    g = (
        pos.select(*keys, "bucket", value)
        .unionByName(none.select(*keys, "bucket", value))
        .groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    )
    rank = F.coalesce(*[F.when(F.col("bucket") == n, F.lit(i)) for n, i in order.items()])
    return g.withColumn("bucket_order", rank)


def category_marginal(
    rows: DataFrame, folds: DataFrame, target: str, category: str, min_train_us: int, test_us: int
) -> DataFrame:
    """Out-of-sample accuracy of P(up | category) against the train window's base rate, per fold.

    Train counts are running sums of (slice, category) counts. A category a fold has not seen gets
    the overall rate. Predictions are +1 or -1, so a flat outcome is never a hit.
    """
    y = F.col(target)
    up, down = F.count(F.when(y > 0, 1)), F.count(F.when(y < 0, 1))
    seen = (
        S.with_train_slice(rows.filter(y.isNotNull()), folds)
        .groupBy(KEY, "slice", category)
        .agg(up.alias("up"), down.alias("down"), F.count(F.lit(1)).alias("n"))
    )
    cats = rows.filter(y.isNotNull()).select(KEY, category).distinct()
    grid = folds.select(KEY, F.col("fold").alias("slice")).join(cats, KEY)
    tr = grid.join(seen, [KEY, "slice", category], "left").fillna(0, ["up", "down", "n"])
    tr = S.running(tr, [KEY, category], "slice", ["up", "down", "n"]).withColumnRenamed("slice", "fold")
    w = W.partitionBy(KEY, "fold")
    tr = tr.withColumns({f"all_{c}": F.sum(c).over(w) for c in ("up", "down", "n")})
    te = (
        S.with_test_fold(rows.filter(y.isNotNull()), folds, min_train_us, test_us)
        .groupBy(KEY, "fold", category)
        .agg(up.alias("t_up"), down.alias("t_down"), F.count(F.lit(1)).alias("t_n"))
    )
    p_up = F.when(F.col("n") > 0, F.col("up") / F.col("n")).otherwise(F.col("all_up") / F.col("all_n"))
    hits = F.when(p_up > 0.5, F.col("t_up")).otherwise(F.col("t_down"))
    return (
        te.join(tr.filter("all_n > 0"), [KEY, "fold", category])
        .groupBy(KEY, "fold")
        .agg(
            F.max("all_n").alias("n_train"),
            F.sum("t_n").alias("n_test"),
            F.max(F.greatest("all_up", "all_down") / F.col("all_n")).alias("base_rate"),
            (F.sum(hits) / F.sum("t_n")).alias("marginal_acc"),
            (F.sum(F.when(F.col(category) == "none", F.col("t_n")).otherwise(0)) / F.sum("t_n")).alias("none_frac"),
        )
    )


def marginal_summary(fold_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted and n_test-weighted mean delta over the folds, and the folds that beat the base rate."""
    d = F.col("marginal_acc") - F.col("base_rate")
    return fold_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"),
        (F.avg(d) * 100).alias("mean_delta_pp"),
        (F.sum(d * F.col("n_test")) / F.sum("n_test") * 100).alias("weighted_delta_pp"),
        F.count(F.when(d > 0, 1)).alias("folds_beating_base_rate"),
    )


def bucket_marginal(
    items: DataFrame, windows: DataFrame, keys: Sequence[str], feature: str, target: str, q: int, settle_us: int,
    min_train: int = 50,
) -> DataFrame:
    """The same test for dated items: train = items whose target is known ``settle_us`` before the window.

    ``windows`` has (keys, fold, test_start, test_end) in microseconds; buckets are left-closed at the
    train quantiles of the feature. No item is copied per window that trains on it.
    """
    win = settle(windows.select(*keys, "fold", "test_start", "test_end"))
    y = F.col(target)
    ups = {"up": F.count(F.when(y > 0, 1)), "down": F.count(F.when(y < 0, 1))}
    train = win.select(*keys, "fold", F.lit(-(1 << 62)).alias("_from"), (F.col("test_start") - F.lit(settle_us) + 1).alias("_until"))
    g = WN.grid(items, train, keys, feature, "t", "_from", "_until", sums=ups)
    gk = [*keys, "fold"]
    edges = settle(WN.quantiles(g, [i / q for i in range(1, q)], out="_e").filter(F.col("n_rows") >= min_train))
    cuts = [F.col(f"_e{i}") for i in range(1, q)]
    counted = ["up", "down", "n"]

    # Train counts of a bucket: what is under its upper edge less what is under its lower one.
    ordered = edges.select(*gk, F.posexplode(F.array_distinct(F.array(*cuts))).alias("_i", "edge"))
    under = settle(WN.below(g, ordered).join(ordered, [*gk, "edge"]))
    by_fold = settle(WN.by_range(g).groupBy(*gk).agg(*[F.sum(c).alias(f"all_{c}") for c in counted]).join(edges.select(*gk), gk))
    last = under.groupBy(*gk).agg(F.max("_i").alias("_i")).withColumn("_i", F.col("_i") + 1).join(by_fold, gk)
    tops = under.select(*gk, "_i", *counted).unionByName(last.select(*gk, "_i", *[F.col(f"all_{c}").alias(c) for c in counted]))
    step = W.partitionBy(*gk).orderBy("_i")
    tr = tops.select(*gk, "_i", *[(F.col(c) - F.coalesce(F.lag(c).over(step), F.lit(0))).alias(c) for c in counted])

    hit = F.explode(F.filter("_w", lambda x: (F.col("t") >= x["test_start"]) & (F.col("t") < x["test_end"])))
    lists = win.groupBy(*keys).agg(F.collect_list(F.struct("fold", "test_start", "test_end")).alias("_w"))
    test = items.filter(F.col(feature).isNotNull()).join(lists, [*keys]).withColumn("_h", hit).withColumn("fold", F.col("_h.fold")).join(edges, gk)
    # Equal edges are one here too, so that a bucket has the same number on both sides.
    test = test.withColumn("_i", F.size(F.filter(F.array_distinct(F.array(*cuts)), lambda e: e <= F.col(feature))))
    te = test.groupBy(*gk, "_i").agg(ups["up"].alias("t_up"), ups["down"].alias("t_down"), F.count(F.lit(1)).alias("t_n"))
    te = te.join(by_fold, gk).join(tr, [*gk, "_i"], "left")
    p_up = F.coalesce(F.col("up") / F.nullif("n", F.lit(0)), F.col("all_up") / F.col("all_n"))
    hits = F.when(p_up > 0.5, F.col("t_up")).otherwise(F.col("t_down"))
    return te.groupBy(*gk).agg(
        F.max("all_n").alias("n_train"),
        F.sum("t_n").alias("n_test"),
        F.max(F.greatest("all_up", "all_down") / F.col("all_n")).alias("base_rate"),
        (F.sum(hits) / F.sum("t_n")).alias("marginal_acc"),
    )


def drift_baseline(rows: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Per symbol and feature: mean, deviation, decile edges (equal ones merged) and bin fractions.

    A column the frame lacks, or one without values, gives a row of NULLs.
    """
    have = [c for c in columns if c in rows.columns]
    parts = F.array(
        *[F.struct(F.lit(c).alias("feature"), (F.col(c) if c in have else F.lit(None).cast("double")).alias("x")) for c in columns]
    )
    d = rows.select(KEY, F.explode(parts).alias("_p")).select(KEY, "_p.*")
    stats = d.groupBy(KEY, "feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    q = R.exact_quantiles(d, [KEY, "feature"], "x", [i / bins for i in range(bins + 1)], out="_e")
    es = [F.col(f"_e{i}") for i in range(1, bins + 2)]
    edges = settle(q.select(KEY, "feature", "n_rows", F.array_distinct(F.array(*es)).alias("bin_edges")))
    inside = d.filter("x is not null").join(edges, [KEY, "feature"])
    below = F.size(F.filter("bin_edges", lambda e: e < F.col("x")))
    binned = inside.withColumn("bin", F.greatest(below - 1, F.lit(0))).groupBy(KEY, "feature", "n_rows", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )
    fractions = binned.groupBy(KEY, "feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.col("n") / F.col("n_rows")))).alias("_m")
    )
    out = stats.join(edges, [KEY, "feature"], "left").join(fractions, [KEY, "feature"], "left")
    slots = F.sequence(F.lit(0), F.greatest(F.size("bin_edges") - 2, F.lit(0)))
    frac = F.transform(slots, lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0.0)))
    return out.select(KEY, "feature", "mean", "std", "bin_edges", F.when(F.col("n_rows") > 0, frac).alias("bin_fractions"))
