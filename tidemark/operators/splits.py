"""Walk-forward folds, purged train membership and sample weights.

A fold never becomes a copy of its rows. Test membership is arithmetic on time, and an expanding
train window is a sum over *slices*: slice f holds the rows that enter training with fold f, so any
additive statistic of fold f's train window is the running sum of the slices up to f. Order statistics
of train windows are in ``operators/windows.py``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.blocks import floor_div
from tidemark.session import settle
from tidemark.tables import DAY

KEY = "symbol"


def spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy(KEY).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def _slot(origin: Column, test_us: int) -> Column:
    """Number of the test window a time falls into; everything before the first is -1."""
    return F.greatest(floor_div(F.col("t") - origin, test_us), F.lit(-1).cast("long"))


def fold_table(
    rows: DataFrame, min_train_us: int, test_us: int, purge_rows: int, max_train_us: int | None = None
) -> DataFrame:
    """One row per fold with its times, row positions and sizes.

    Windows start ``min_train_us`` after a symbol's first row and follow each other while they start
    strictly before its last row. The train window ends ``purge_rows`` rows before the test window
    and begins at the first row, or ``max_train_us`` before the test window. Folds without train or
    test rows are left out and take no number.
    """
    span = settle(spans(rows))
    d = rows.select(KEY, "t").join(span, KEY)
    origin = F.col("first_t") + F.lit(min_train_us)
    n = floor_div(F.col("last_t") - origin + F.lit(test_us - 1), test_us)
    slots = span.select(
        KEY, "first_t", F.explode(F.sequence(F.lit(-1).cast("long"), F.greatest(n, F.lit(0)) - 1)).alias("slot")
    )
    test_n = d.groupBy(KEY, _slot(origin, test_us).alias("slot")).agg(F.count(F.lit(1)).alias("n_test"))
    out = slots.join(test_n, [KEY, "slot"], "left").fillna(0, ["n_test"])
    before = W.partitionBy(KEY).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    if max_train_us is None:
        out = out.withColumn("old", F.lit(0).cast("long"))
    else:
        old_n = d.groupBy(KEY, _slot(origin - F.lit(max_train_us), test_us).alias("slot")).agg(
            F.count(F.lit(1)).alias("old_n")
        )
        out = out.join(old_n, [KEY, "slot"], "left").withColumn("old", F.coalesce(F.sum("old_n").over(before), F.lit(0)))
    out = out.withColumn("test_pos", F.coalesce(F.sum("n_test").over(before), F.lit(0)))
    out = out.withColumns(
        {
            "test_start": F.col("first_t") + F.lit(min_train_us) + F.col("slot") * F.lit(test_us),
            "train_pos": F.col("old"),
            "train_end_pos": F.greatest(F.col("test_pos") - F.lit(purge_rows), F.lit(0)),
        }
    ).withColumns(
        {
            "test_end": F.col("test_start") + F.lit(test_us),
            "n_train": F.greatest(F.col("train_end_pos") - F.col("train_pos"), F.lit(0)),
        }
    )
    out = out.filter("slot >= 0 and n_test > 0 and n_train > 0")
    fold = F.row_number().over(W.partitionBy(KEY).orderBy("slot")) - 1
    # A handful of rows per symbol that every later step joins: written once, broadcast by its size.
    return settle(out.select(
        KEY, fold.alias("fold"), "slot", "test_start", "test_end", "train_pos", "train_end_pos", "test_pos", "n_train", "n_test",
        "first_t",
    ))


def with_test_fold(rows: DataFrame, folds: DataFrame, min_train_us: int, test_us: int) -> DataFrame:
    """Rows that belong to a test window, with ``fold``, ``test_start`` and ``test_end``."""
    starts = folds.groupBy(KEY).agg(F.min("first_t").alias("first_t"))
    slot = _slot(F.col("first_t") + F.lit(min_train_us), test_us)
    d = rows.join(starts, KEY).withColumn("slot", slot).drop("first_t")
    return d.join(folds.select(KEY, "slot", "fold", "test_start", "test_end"), [KEY, "slot"]).drop("slot")


def with_train_slice(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with ``slice``: the first fold whose (expanding) train window holds the row.

    Rows no fold trains on are dropped. The bounds array has one number per fold of the symbol.
    """
    bounds = folds.groupBy(KEY).agg(F.sort_array(F.collect_list("train_end_pos")).alias("_ends"))
    d = rows.join(bounds, KEY)
    d = d.withColumn("slice", F.size(F.filter("_ends", lambda e: e <= F.col("pos"))))
    return d.filter(F.col("slice") < F.size("_ends")).drop("_ends")


def running(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Replace additive columns by their running sums over the (few) ordered rows of each key."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.sum(c).over(w) for c in cols})


def recency_weight(t: Column, as_of: Column, half_life_days: float) -> Column:
    """exp(-ln 2 / half-life * age in days), the age measured from the fold's test start."""
    return F.exp(F.lit(-math.log(2) / half_life_days / DAY) * (as_of - t))


def recency_sums(rows: DataFrame, folds: DataFrame, half_life_days: float, sums: dict[str, Column]) -> DataFrame:
    """(symbol, fold, n_rows, sums): ``sums`` over an expanding train window, each row weighted by its age.

    Expressions may use ``wt``. A slice is summed with the ages counted from the first fold that holds it; a weight is a
    power, so a later fold takes the whole slice over with one factor. Rows are read once, not once per fold.
    """
    starts = folds.select(KEY, "fold", "test_start")
    order = folds.groupBy(KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("fold", "test_start"))), lambda x: x["test_start"]).alias("_starts"))
    d = with_train_slice(rows, folds).join(order, KEY)
    since = F.element_at("_starts", F.col("slice") + 1)
    d = d.withColumn("wt", recency_weight(F.col("t"), since, half_life_days))
    per = settle(d.groupBy(KEY, "slice", since.alias("_since")).agg(F.count(F.lit(1)).alias("n_rows"), *[a.alias(k) for k, a in sums.items()]))
    j = starts.join(per, KEY).filter(F.col("slice") <= F.col("fold"))
    w = recency_weight(F.col("_since"), F.col("test_start"), half_life_days)
    return j.groupBy(KEY, "fold").agg(F.sum("n_rows").alias("n_rows"), *[F.sum(F.col(k) * w).alias(k) for k in sums])


def last_days(rows: DataFrame, days: float, order: str = "t") -> DataFrame:
    """Rows of the last ``days`` days of each symbol, the newest row's own time being day 0."""
    newest = settle(rows.groupBy(KEY).agg(F.max(order).alias("_max")))  # its true size lets the planner broadcast it
    return rows.join(newest, KEY).filter(F.col(order) >= F.col("_max") - F.lit(int(days * DAY))).drop("_max")


def holdout(rows: DataFrame, days: float = 30.0, order: str = "t") -> DataFrame:
    """Rows marked ``part`` = 'train' / 'holdout' by the last ``days`` days of their symbol."""
    newest = settle(rows.groupBy(KEY).agg(F.max(order).alias("_max")))  # its true size lets the planner broadcast it
    old = F.col(order) < F.col("_max") - F.lit(int(days * DAY))
    return rows.join(newest, KEY).withColumn("part", F.when(old, "train").otherwise("holdout")).drop("_max")


# Fold numbers used to select and to judge.
SELECT_FOLDS = range(0, 5)
JUDGE_FOLDS = range(5, 9)


def with_fold_sets(rows: DataFrame, sets: dict[str, range] | None = None) -> DataFrame:
    """One copy of a row per fold set that holds its fold (select, judge, all)."""
    sets = sets or {"select": SELECT_FOLDS, "judge": JUDGE_FOLDS, "all": range(0, 9)}
    tags = [F.when(F.col("fold").isin(*list(r)), F.lit(name)) for name, r in sets.items()]
    return rows.withColumn("fold_set", F.explode(F.array_compact(F.array(*tags))))
