"""Parameter grids: cells, ranking, finalists, marginals and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def param_grid(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the axes' values, exploded from one row."""
    d = spark.range(1).drop("id")
    for name, values in axes.items():
        d = d.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return d


def ranked(pooled: DataFrame, metric: str = "directional_accuracy") -> DataFrame:
    """Candidates best first; equal scores by lower error, then by name."""
    return pooled.orderBy(F.desc(metric), "mae", "cell")


def finalists(pooled: DataFrame, k: int, metric: str = "directional_accuracy") -> DataFrame:
    """The k best *distinct* cells, each with its best variant."""
    best = W.partitionBy("cell").orderBy(F.desc(metric), "mae")
    one = pooled.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    return ranked(one, metric).limit(k)


def versus_default(pooled: DataFrame, is_default) -> DataFrame:
    """Accuracy in points and error in percent against the default candidate.

    One row per grid cell, so the window over all of them is as small as the grid.
    """
    w = W.partitionBy(F.lit(1))
    da = F.max(F.when(is_default, F.col("directional_accuracy"))).over(w)
    mae = F.max(F.when(is_default, F.col("mae"))).over(w)
    return pooled.withColumns(
        {
            "da_pct": F.col("directional_accuracy") * 100,
            "delta_vs_default_pp": (F.col("directional_accuracy") - da) * 100,
            "mae_vs_default_pct": (F.col("mae") / mae - 1) * 100,
        }
    )


def marginals(scored: DataFrame, axes: Sequence[str], metric: str = "da_pct") -> DataFrame:
    """Mean, best and worst score per value of every axis."""
    parts = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in axes])
    return (
        scored.withColumn("_a", F.explode(parts))
        .groupBy("_a.axis", "_a.level")
        .agg(F.avg(metric).alias("mean"), F.max(metric).alias("max"), F.min(metric).alias("min"), F.count(F.lit(1)).alias("n"))
    )


def verdicts(results: DataFrame) -> DataFrame:
    """Pass when the judge interval lies above zero and the select delta is not negative.

    ``results`` has (variant, fold_set in select/judge, delta_da_pp, ci_lo_pp).
    """
    def pick(s, c):
        return F.max(F.when(F.col("fold_set") == s, F.col(c)))

    g = results.groupBy("symbol", "variant").agg(
        pick("judge", "ci_lo_pp").alias("judge_ci_lo_pp"), pick("judge", "delta_da_pp").alias("judge_delta_pp"),
        pick("select", "delta_da_pp").alias("select_delta_pp"),
    )
    return g.withColumn("passes", (F.col("judge_ci_lo_pp") > 0) & (F.col("select_delta_pp") >= 0))
