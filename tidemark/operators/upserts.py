"""Insert-ignore, keyed updates, cache extension and missing-work detection on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key in arrival order; partial aggregation, so a hot key is no problem."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def dedup_by_url(batch: DataFrame, known: DataFrame, order: Sequence[str]) -> DataFrame:
    """Batch rows whose url is neither known nor seen earlier in the batch."""
    return first_per_key(batch, ["url"], order).join(known.select("url").distinct(), "url", "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows to append: one per new key. Existing keys keep their row."""
    return first_per_key(batch, keys, order).join(target.select(*keys).distinct(), [*keys], "left_anti")


def keyed_update(target: DataFrame, updates: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """New snapshot with ``cols`` replaced where an update row exists.

    An update may write NULL or an empty string; both are kept as given, since "not tried" and
    "nothing found" are different states.
    """
    u = updates.select(key, F.struct(*cols).alias("_u"))
    new = {c: F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)) for c in cols}
    return target.join(u, key, "left").withColumns(new).select(*target.columns)


def pending(rows: DataFrame, column: str, key: str = "url", asset: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose column was never filled (NULL, not empty), oldest first; ``limit`` is a batch size."""
    d = rows.filter(F.col(column).isNull())
    if asset is not None:
        d = d.filter(F.array_contains("assets", asset))
    d = d.orderBy(key)
    return d if limit is None else d.limit(limit)


def extend_cache(cache: DataFrame, fresh: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Cache plus newer rows, duplicates keep the cached row."""
    tag = cache.withColumn("_age", F.lit(0)).unionByName(fresh.withColumn("_age", F.lit(1)))
    return first_per_key(tag, [*keys], ["_age", order]).drop("_age")


def newer_than_cache(cache: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """Fresh rows after the newest cached one of their key, all rows of keys the cache lacks."""
    top = cache.groupBy(key).agg(F.max(order).alias("_top"))
    return fresh.join(top, key, "left").filter(F.col("_top").isNull() | (F.col(order) > F.col("_top"))).drop("_top")


def missing_days(have: DataFrame, key: str, day: Column, start: str, end: str) -> DataFrame:
    """(key, day) from start to end, both included, that have no row."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    want = have.select(key).distinct().withColumn("day", F.explode(days))
    return want.join(have.select(key, day.cast("date").alias("day")).distinct(), [key, "day"], "left_anti")


def todo(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned work without a finished row."""
    return planned.join(done.select(*keys).distinct(), [*keys], "left_anti")
