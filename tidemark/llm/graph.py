"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import settle


def _lows(pairs: DataFrame, node: str, other: str) -> DataFrame:
    return pairs.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Each round points every node at a smaller neighbour; the table of a round is written to the shared folder, so a
    lost executor costs one round. Minima are pre-aggregated and joined back, hence a node with very many neighbours is
    a skewed join, which AQE splits. NULL ends and loops are left out; an empty table gives an empty result.
    """
    e = settle(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    mark = None
    while True:
        both = e.select(F.col("v").alias("n"), F.col("u").alias("m")).unionAll(e.select(F.col("u").alias("n"), F.col("v").alias("m")))
        low = _lows(both, "n", "m").select("node", F.least("node", "low").alias("low"))
        large = both.join(low, both.n == low.node).where("m > n").select(F.col("m").alias("v"), F.col("low").alias("u")).distinct()
        large = settle(large)
        low = _lows(large, "v", "u")
        down = large.join(low, large.v == low.node).where("u <> low").select(F.col("u").alias("v"), F.col("low").alias("u"))
        e = settle(down.unionAll(low.select(F.col("node").alias("v"), F.col("low").alias("u"))).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum("u")).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(
        e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
