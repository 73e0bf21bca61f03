"""Novelty of an item against the preceding 24 hours: one minus its largest cosine.

Items are packed into vectors-of-a-block rows of bounded size. Only pairs of *blocks* whose times
overlap meet in a join; a block pair is one matrix product, and it hands back one maximum per item,
never the item pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.blocks import floor_div, with_position
from tidemark.tables import DAY

BLOCK = 256


def normalised(vec):
    n = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: F.coalesce(x.cast("double") / F.nullif(n, F.lit(0.0)), F.lit(0.0)))


def counts_before(items: DataFrame, keys: Sequence[str], window_us: int) -> DataFrame:
    """``news_count_24h``: items placed before this one (by time, then id) with t >= own t - window.

    That is the item's position minus the number of items older than the window; the latter is the
    position of the first item at or after t - window.
    """
    from tidemark.operators.asof import asof

    first = items.groupBy(*keys, "t").agg(F.min("pos").alias("first_pos"))
    edge = items.select(*keys, "id", "pos", (F.col("t") - F.lit(window_us)).alias("t"))
    hit = asof(edge, first, keys, ["first_pos"], forward=True)
    return hit.select(*keys, "id", (F.col("pos") - F.col("first_pos")).alias("news_count_24h"))


def novelty(items: DataFrame, keys: Sequence[str], window_us: int = DAY, size: int = BLOCK) -> DataFrame:
    """(keys, id, t, novelty, news_count_24h) for items (keys, id, t, vec).

    ``vec`` is an array of doubles; it is scaled to length one here. Ties in time are ordered by id.
    """
    d = with_position(items.withColumn("vec", normalised(F.col("vec"))), keys, "t", window_us, ties=["id"])
    b = d.withColumn("b", floor_div(F.col("pos"), size))
    rows = F.sort_array(F.collect_list(F.struct("pos", "t", "id", "vec")))
    packed = b.groupBy(*keys, "b").agg(rows.alias("r"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    flat = packed.select(*keys, "b", "r.pos", "r.t", "r.id", F.flatten("r.vec").alias("vec"))
    left = flat.select(*keys, F.col("b").alias("lb"), *[F.col(c).alias(f"l_{c}") for c in ("pos", "t", "id", "vec")])
    right = flat.select(*keys, F.col("b").alias("rb"), *[F.col(c).alias(f"r_{c}") for c in ("pos", "t", "vec")])
    # A block needs the blocks from the first one that reaches into its window up to itself.
    reach = _first_block(packed.select(*keys, "b", "t_min", "t_max"), keys, window_us)
    need = reach.select(*keys, F.col("b").alias("lb"), F.explode(F.sequence("first_b", "b")).alias("rb"))
    # The key travels as one value, so that an id under two keys stays two items.
    jobs = need.join(left, [*keys, "lb"]).join(right, [*keys, "rb"]).withColumn("_key", F.to_json(F.struct(*keys))).drop(*keys, "lb", "rb")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for j in pdf.itertuples():
                a = np.asarray(j.l_vec, dtype=float).reshape(len(j.l_pos), -1)
                c = np.asarray(j.r_vec, dtype=float).reshape(len(j.r_pos), -1)
                ok = (j.r_pos[None, :] < j.l_pos[:, None]) & (j.r_t[None, :] >= j.l_t[:, None] - window_us)
                top = np.where(ok, a @ c.T, -np.inf).max(axis=1)
                keep = np.isfinite(top)
                yield pd.DataFrame({"key": j.key, "id": j.l_id[keep], "best": top[keep]})

    id_type = items.schema["id"].dataType.simpleString()
    found = jobs.withColumnRenamed("_key", "key").mapInPandas(best, f"key string, id {id_type}, best double")
    found = found.groupBy("key", "id").agg(F.max("best").alias("best")).withColumnRenamed("key", "_key")
    counts = counts_before(d.select(*keys, "id", "t", "pos"), keys, window_us).select(*keys, "id", "news_count_24h")
    return (
        d.select(*keys, "id", "t")
        .withColumn("_key", F.to_json(F.struct(*keys)))
        .join(found, ["_key", "id"], "left")
        .join(counts, [*keys, "id"], "left")
        .select(*keys, "id", "t", F.coalesce(1 - F.col("best"), F.lit(1.0)).alias("novelty"), "news_count_24h")
    )


def _first_block(spans: DataFrame, keys: Sequence[str], window_us: int) -> DataFrame:
    """For every block the first block of its key whose newest item is inside the oldest item's window."""
    from tidemark.operators.asof import asof

    ends = spans.groupBy(*keys, F.col("t_max").alias("t")).agg(F.min("b").alias("first_b"))
    q = spans.select(*keys, "b", (F.col("t_min") - F.lit(window_us)).alias("t"))
    return asof(q, ends, keys, ["first_b"], forward=True).select(*keys, "b", "first_b")
