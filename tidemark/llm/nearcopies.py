"""Near copies by exact Jaccard similarity of word shingles.

Texts of equal sets collapse to one row first. SimHash fingerprints of these rows are linked at ``BITS`` differing bits or
fewer (``simhash.links``), and each linked row is held against the first of its group on the whole shingle sets; near ones
go. Most pairs at 0.8 differ in more bits, so a second search follows among what is left. Rows that share one of ``BANDS`` min-hash keys of ``ROWS`` minima with
another go on; a pair at the similarity of 0.8 shares none with a chance of (1 - 0.8 ** 4) ** 20 = 2.7e-5, a closer one
with less. Among those rows every shingle is counted, and each row is posted under its rarest ones: two sets as similar as
that share one of them. What only a template has in common is too frequent to be posted, so unlike documents of one
template do not meet. In a posting list every row is held against the first, then what is left against the next two,
four, eight: a group of near copies is done in one round, and a list of n rows in log2(n). Each pair is verified on the
whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.base import over_batches, raw
from tidemark.llm.graph import components
from tidemark.llm.simhash import links, shingle_hashes, simhash
from tidemark.session import settle

WIDTH = 5  # words in a shingle
NEAR = (4, 5)  # least similarity of a link, as a fraction
BANDS, ROWS = 20, 4
CHUNK = 1 << 13  # shingles whose hashes are held for all minima at a time

_RNG = np.random.default_rng(42)
_MIX = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_BY = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key a band; none without shingles."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), CHUNK):
        low = np.minimum(low, ((hashes[i : i + CHUNK, None] ^ _MIX) * _BY).min(0))
    keys = [xxhash.xxh64_intdigest(part.tobytes(), b) for b, part in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, d1, d2, keys, bits): size and digest of the shingle set, its band keys, and the text's fingerprint."""

    def run(b: pa.RecordBatch) -> dict:
        hashes = [shingle_hashes(t, width) for t in raw(b, "text")]
        bits = np.array([simhash(h) for h in hashes], np.uint64).view(np.int64)
        sets = [np.unique(h) for h in hashes]
        d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        return {"doc_id": b.column("doc_id"), "n": [len(s) for s in sets], "d1": d[:, 0], "d2": d[:, 1], "keys": [band_keys(s) for s in sets], "bits": bits}

    return over_batches(docs.select("doc_id", "text"), "doc_id long, n long, d1 long, d2 long, keys array<long>, bits long", run)


def grouped(reps: DataFrame) -> DataFrame:
    """(a, b): each row of (rep, bits) with the first row of its fingerprint's group, if that is another one."""
    prints = settle(reps.groupBy("bits").agg(F.min("rep").alias("rep")))
    named = components(links(prints)).withColumnRenamed("node", "rep")
    first = prints.join(named, "rep", "left").select("bits", F.coalesce("component", "rep").alias("a"))
    return settle(reps.join(first, "bits").where("rep <> a").select("a", F.col("rep").alias("b")))


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, s): the different shingle hashes of each text."""

    def run(b: pa.RecordBatch) -> dict:
        return {"id": b.column("doc_id"), "s": [np.unique(shingle_hashes(t, width)).view(np.int64) for t in raw(b, "text")]}

    return over_batches(docs.select("doc_id", "text"), "id long, s array<long>", run)


def partnered(reps: DataFrame) -> DataFrame:
    """(rep): the rows of (rep, keys) that share a key with another row."""
    keys = reps.select(F.explode("keys").alias("key"), "rep")
    shared = settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"))
    return keys.join(shared, "key", "left_semi").select("rep").distinct()


def reaches(left, n, m):
    """Whether a set of n shingles can be near one of m, if the two have at most ``left`` in common."""
    up, down = NEAR
    return left * (up + down) >= (n + m) * up


def postings(sets: DataFrame) -> DataFrame:
    """(h, rep, n, left): each set (rep, s) under those of its rarest shingles that another set has too, with the number
    of its shingles from there on.

    A set of n shingles is posted under its n - ceil(0.8 n) + 1 rarest, ties by hash. Shingles that no other set has
    come first in that order and need no posting. Where the first shingle that two sets share stands, the rest of
    either bounds what they share; so a place serves only partners up to some size. One that does not serve partners of
    its own size waits for smaller ones, and goes if its list has none. Of sets that have a large part in common and are
    still not near, hardly a place is left.
    """
    up, down = NEAR
    each = sets.select("rep", F.size("s").alias("n"), F.explode("s").alias("h"))
    df = settle(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    known = each.join(df, "h")
    w = Window.partitionBy("rep")
    at = F.row_number().over(w.orderBy("df", "h")) + F.col("n") - F.count(F.lit(1)).over(w)
    kept = known.withColumn("__at", at).where(F.col("__at") <= F.col("n") - F.ceil(F.col("n") * up / down) + 1)
    left = kept.select("h", "rep", "n", (F.col("n") - F.col("__at") + 1).alias("left"))
    least = F.min(F.when(reaches(F.col("left"), F.col("n"), F.col("n")), F.col("n"))).over(Window.partitionBy("h"))
    return left.withColumn("__least", least).where(reaches(F.col("left"), F.col("n"), F.col("__least"))).drop("__least")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets (rep, s) have the least similarity or more."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    up, down = NEAR
    return settle(both.where(common * down >= (F.size("sa") + F.size("sb") - common) * up).select("a", "b"))


def later_copies(lists: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(rep): rows with a near copy of a smaller number, so that no two of the others are near; None without pairs.

    ``lists`` are postings (h, rep, n, left). A round takes the first 1, 2, 4, ... rows of every list as leaders and holds the
    list's later rows against them; linked rows leave all lists, leaders leave the list they have led.
    """
    up, down = NEAR
    out, done, leaders = None, None, 1
    fits = (F.least("na", "n") * down >= F.greatest("na", "n") * up) & reaches(F.least("lefta", "left"), F.col("na"), F.col("n"))
    while True:
        first = F.row_number().over(Window.partitionBy("h").orderBy("rep"))
        lead = settle(lists.withColumn("__k", first).where(F.col("__k") <= leaders).select("h", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("left").alias("lefta")))
        pairs = lists.join(lead, "h").where((F.col("a") < F.col("rep")) & fits).select("a", F.col("rep").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = settle(pairs)
        good = verified(pairs, sets)
        gone = good.select(F.col("b").alias("rep")).distinct()
        out = gone if out is None else out.unionByName(gone)
        done = pairs if done is None else done.unionByName(pairs)
        led = lead.select("h", F.col("a").alias("rep"))
        lists = settle(lists.join(gone, "rep", "left_anti").join(led, ["h", "rep"], "left_anti"))
        if lists.isEmpty():
            return out.distinct()
        leaders *= 2


def keep_first(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without near copies of others: what goes is linked to a smaller doc_id, and no two that stay are near
    (but for the chance named above).

    Rows that repeat a doc_id are one document: the first by text stays. Texts without words are copies of each other.
    Rows without doc_id cannot be named, so they stay. An empty table stays empty; all columns are carried along, and
    whole texts are moved only to leave rows out.
    """
    named = docs.where("doc_id is not null")
    repeated = settle(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("doc_id"))
    once = named
    if not repeated.isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
        some = named.join(repeated, "doc_id", "left_semi").withColumn("__first", first).where("__first = 1").drop("__first")
        once = named.join(repeated, "doc_id", "left_anti").unionByName(some.select(named.columns))
    sig = settle(signatures(once, width))
    classes = settle(sig.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    copies = sig.join(classes, ["d1", "d2"]).where("doc_id <> rep").select(F.col("doc_id").alias("__gone"))
    reps = sig.join(classes.select("rep"), F.col("doc_id") == F.col("rep")).select("rep", "keys", "bits")
    pairs = grouped(reps.select("rep", "bits"))
    some = settle(partnered(reps).unionByName(pairs.select(F.explode(F.array("a", "b")).alias("rep"))).distinct())
    sets = settle(shingle_sets(once.join(some, once.doc_id == some["rep"], "left_semi"), width).withColumnRenamed("id", "rep"))
    close = settle(verified(pairs, sets).select(F.col("b").alias("rep")))
    near = later_copies(settle(postings(sets.join(close, "rep", "left_anti"))), sets)
    copies = copies.unionByName(close.select(F.col("rep").alias("__gone")))
    gone = settle(copies if near is None else copies.unionByName(near.select(F.col("rep").alias("__gone"))))
    return once.join(gone, once.doc_id == gone["__gone"], "left_anti").unionByName(docs.where("doc_id is null"))
