"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each pivot has an inverted file of the vectors that list it,
with the place it has there. A query walks the files of its own pivots and adds up what each shared pivot takes off the
footrule distance of the two lists; the best by footrule are reranked by cosine on the original vectors. The index is
cut into shards of vectors, and queries visit all shards in blocks, so no task holds more than one shard and one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.base import over_batches
from tidemark.session import settle

PIVOTS = 128
LISTED = 64  # nearest pivots in a vector's list
SAMPLE = 4096  # vectors drawn to choose pivots from
DEPTH = 0.15  # share of a shard that is reranked for a query, with all ties of the last footrule
LEAST = 500  # and this many at least
SHARD = 16384  # distinct vectors of a shard
BLOCK = 4096  # queries of a block
EVERY = 50  # vec_ids divisible by this are queries
NEAREST = 5
ROUNDING = 1e-9  # more than two ways of summing a cosine differ by


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has a direction: not NULL, no NULL or non-finite component, not zero, id not NULL."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.where("vec_id is not null and embedding is not null").where(fine & some)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that very small and large rows keep their direction."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def stacked(col: pa.Array) -> np.ndarray:
    return np.array(col.to_pylist(), np.float64)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Each next pivot is the sampled direction that is farthest from the pivots so far."""
    if not len(sample):
        return sample
    picked = [0]
    near = sample @ sample[0]
    while len(picked) < min(n, len(sample)):
        i = int(near.argmin())
        if near[i] >= 1 - 1e-9:
            break  # every other direction is a pivot already
        picked.append(i)
        near = np.maximum(near, sample @ sample[i])
    return sample[picked]


def nearest_pivots(u: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each row in order, ties to the smaller number."""
    return np.argsort(-np.round(u @ pivots.T, 12), axis=1, kind="stable")[:, :k].astype(np.int16)


class Shard:
    """Inverted files over some vectors: for each pivot a row with what each vector's place of it is worth, k at the first
    place, 0 for vectors that do not list it. A vector lists half of the pivots, so whole rows are added up faster than
    the listed vectors alone, which stand apart."""

    def __init__(self, lists: np.ndarray, pivots: int):
        self.n, self.k = lists.shape
        self.worth = self.k - np.arange(self.k, dtype=np.int32)
        self.files = np.zeros((pivots, self.n), np.int32)
        self.files[lists, np.arange(self.n)[:, None]] = self.worth

    def gains(self, mine: np.ndarray) -> np.ndarray:
        """What shared pivots take off the footrule distance, by vector. With lists of length k and k as the place of
        a pivot that is not listed, a pivot at places i and j counts (k - i) + (k - j) - |i - j| = 2 (k - max(i, j))."""
        out = np.zeros(self.n, np.int32)
        for p, worth in zip(mine, self.worth):
            out += np.minimum(self.files[p], worth)
        return 2 * out


def cosines(u: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of unit rows, summed in one order whatever stands beside them, so that equal vectors get equal scores."""
    return np.clip((u * q).sum(axis=1), -1.0, 1.0)


def nearest_rows(u: np.ndarray, rows: np.ndarray, firsts: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` of ``rows`` nearest to q with their cosines, nearest first, ties to the smaller of ``firsts``.

    A product of the matrix finds them up to rounding; only what is that close is summed in the fixed order and sorted.
    """
    near = u[rows]
    if len(rows) > n:
        about = near @ q
        close = np.flatnonzero(about >= np.partition(about, len(rows) - n)[len(rows) - n] - ROUNDING)
        rows, near = rows[close], near[close]
    score = cosines(near, q)
    top = np.lexsort((firsts[rows], -score))[:n]
    return rows[top], score[top]


def distinct_vectors(good: DataFrame, copies: int) -> DataFrame:
    """(vec_id, embedding, ids): one row per distinct vector with its ``copies`` smallest ids.

    Ranks above ``copies`` are dropped before the shuffle as well (a window that is only asked for its first rows), so a
    vector that a third of all rows share sends a few rows per task.
    """
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    first = good.select("vec_id", "embedding").withColumn("rank", rank).where(F.col("rank") <= copies)
    return first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "embedding", "ids")


def search(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, pivots: int = PIVOTS, listed: int = LISTED, depth: float = DEPTH, least: int = LEAST, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` neighbours found for every vector whose id is divisible by ``every``.

    Score is the cosine in double precision; nearest first, ties to the smaller id; a query's own row is no candidate,
    its copies are. Vectors without a direction (``usable``) take no part, nor do vectors of another length than most.
    Copies are searched as one vector and listed by id. A vec_id on several rows stands for each of its vectors once.
    An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    good = usable(vectors)
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    good = good.where(F.size("embedding") == sizes[0].d).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    base = settle(distinct_vectors(good, nearest + 1))
    n = base.count()
    drawn = base.orderBy(F.xxhash64(F.lit("pivots"), "embedding"), "vec_id").limit(SAMPLE).select("embedding").collect()
    shipped = spark.sparkContext.broadcast(choose_pivots(unit(np.array([r.embedding for r in drawn])), pivots))
    k = min(listed, len(shipped.value))
    shards = -(-n // shard)

    def lists(b: pa.RecordBatch) -> dict:
        return {**{c: b.column(c) for c in ("vec_id", "embedding", "ids")}, "near": list(nearest_pivots(unit(stacked(b.column("embedding"))), shipped.value, k))}

    index = settle(over_batches(base, "vec_id long, embedding array<double>, ids array<long>, near array<short>", lists))
    index = index.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    ask = good.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").distinct()
    queries = settle(over_batches(ask, "vec_id long, embedding array<double>, near array<short>", lambda b: {**{c: b.column(c) for c in ("vec_id", "embedding")}, "near": list(nearest_pivots(unit(stacked(b.column("embedding"))), shipped.value, k))}))
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding", "near", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visit(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(mine) and len(theirs):
            u = unit(np.stack(theirs["embedding"].to_numpy()))
            files = Shard(np.stack(theirs["near"].to_numpy()), len(shipped.value))
            ids, firsts = theirs["ids"].to_numpy(), theirs["vec_id"].to_numpy()
            want = min(len(u), max(least, int(np.ceil(depth * len(u)))))
            qu = unit(np.stack(mine["embedding"].to_numpy()))
            for q, own, near in zip(mine["query_id"].to_numpy(), qu, mine["near"].to_numpy()):
                gain = files.gains(near)
                cut = np.partition(gain, len(u) - want)[len(u) - want]
                rows = np.flatnonzero(gain >= cut)
                found = [(-s, v) for i, s in zip(*nearest_rows(u, rows, firsts, own, nearest + 1)) for v in ids[i] if v != q]
                out += [(q, int(v), -s) for s, v in sorted(found)[:nearest]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(visit, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
