"""Paired moving-block bootstrap of a difference in directional accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import settle

KEY = "symbol"


def draw_start(seed: int, draw: Column, slot: Column, n_starts: Column) -> Column:
    """Reproducible block start: 32 bits of an MD5 over (seed, draw, slot), modulo the starts.

    A hash needs no generator state, so a lost task redraws the same numbers, and any other engine
    can repeat them.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), slot.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), n_starts)


def block_bootstrap(
    daily: DataFrame, a: str, b: str, horizons: Sequence[int], block_days: int = 7, n_boot: int = 10_000, seed: int = 0
) -> DataFrame:
    """Per symbol and horizon, plus 'pooled': accuracies, delta, 95 % interval, P(delta > 0), MAE delta.

    Both variants use the same resampled day blocks. Days are summed into block totals once; a draw
    only adds block totals. The work per draw is spread over (symbol, draw).
    """
    labels = [str(h) for h in horizons] + ["pooled"]
    # The daily table is read several times below and is small: compute it once.
    d = settle(daily.filter(F.col("variant").isin(a, b) & F.col("horizon").isin(*horizons)))

    def total(v, src):
        return F.sum(F.when(F.col("variant") == v, F.col(src)).otherwise(0))

    both = F.explode(F.array(F.col("horizon").cast("string"), F.lit("pooled")))
    sums = d.withColumn("label", both).groupBy(KEY, "day", "label").agg(
        *[
            total(v, src).alias(f"{s}{side}")
            for side, v in (("a", a), ("b", b))
            for s, src in (("n", "n"), ("c", "n_dir_correct"), ("e", "sum_abs_err"))
        ]
    )
    # One row per (day, label), also for days on which a horizon has no pairs.
    by_day = W.partitionBy(KEY).orderBy("day")
    days = d.select(KEY, "day").distinct().withColumns(
        {"ix": F.row_number().over(by_day) - 1, "n_days": F.count(F.lit(1)).over(W.partitionBy(KEY))}
    )
    cols = ["na", "ca", "ea", "nb", "cb", "eb"]
    grid = days.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    grid = grid.join(sums, [KEY, "day", "label"], "left").fillna(0, cols)
    shape = grid.groupBy(KEY, "label", "n_days").agg(*[F.sum(c).alias(f"t_{c}") for c in cols])
    blk = F.least(F.lit(block_days), F.col("n_days"))
    n_blocks = F.ceil(F.col("n_days") / blk)

    counts = ["na", "ca", "nb", "cb"]
    by_ix = W.partitionBy(KEY, "label").orderBy("ix")
    block, run = by_ix.rowsBetween(0, block_days - 1), by_ix.rowsBetween(W.unboundedPreceding, 0)
    blocks = grid.withColumns(
        {
            "last_len": F.col("n_days") - (n_blocks - 1) * blk,
            **{f"f_{c}": F.sum(c).over(block) for c in counts},
            **{f"u_{c}": F.sum(c).over(run) for c in counts},
        }
    )
    # The last block of a draw is cut to the rest of the days: a difference of two running sums.
    ends = blocks.select(KEY, "label", F.col("ix").alias("end_ix"), *[F.col(f"u_{c}").alias(f"w_{c}") for c in counts])
    starts = (
        blocks.withColumn("end_ix", F.col("ix") + F.col("last_len") - 1)
        .join(ends, [KEY, "label", "end_ix"], "left")
        .select(
            KEY, "label", F.col("ix").cast("long").alias("start"), *[f"f_{c}" for c in counts],
            *[(F.col(f"w_{c}") - F.col(f"u_{c}") + F.col(c)).alias(f"p_{c}") for c in counts],
        )
    )

    draws = (
        days.select(KEY, "n_days").distinct()
        .withColumns({"n_blocks": n_blocks, "n_starts": F.col("n_days") - blk + 1})
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        .repartition(KEY, "draw")
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .withColumn("start", draw_start(seed, F.col("draw"), F.col("slot"), F.col("n_starts")))
    )
    last = F.col("slot") == F.col("n_blocks") - 1
    g = draws.join(starts, [KEY, "start"]).groupBy(KEY, "label", "draw").agg(
        *[F.sum(F.when(last, F.col(f"p_{c}")).otherwise(F.col(f"f_{c}"))).alias(c) for c in counts]
    )

    def rate(x, side, p=""):
        return F.col(f"{p}{x}{side}") / F.nullif(F.col(f"{p}n{side}").cast("double"), F.lit(0.0))

    delta = rate("c", "b") - rate("c", "a")
    # n_boot values per symbol and label: the exact percentile's buffer is bounded by the parameter.
    ci = g.withColumn("delta", delta).groupBy(KEY, "label").agg(
        F.percentile("delta", [0.025, 0.975]).alias("ci"), F.avg((F.col("delta") > 0).cast("int")).alias("p_delta_gt_0")
    )
    da_a, da_b = rate("c", "a", "t_"), rate("c", "b", "t_")
    mae_a, mae_b = rate("e", "a", "t_"), rate("e", "b", "t_")
    return shape.join(ci, [KEY, "label"]).select(
        KEY, F.col("label").alias("horizon"), "n_days", da_a.alias("da_a"), da_b.alias("da_b"),
        ((da_b - da_a) * 100).alias("delta_da_pp"), (F.col("ci")[0] * 100).alias("ci_lo_pp"),
        (F.col("ci")[1] * 100).alias("ci_hi_pp"), "p_delta_gt_0", mae_a.alias("mae_a"), mae_b.alias("mae_b"),
        ((mae_b - mae_a) / F.nullif(mae_a, F.lit(0.0)) * 100).alias("delta_mae_pct"),
    )
