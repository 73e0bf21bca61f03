"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A 64-bit fingerprint is cut into ``SEGMENTS`` parts. Two fingerprints at Hamming distance ``bits`` or less agree up to
``bits // SEGMENTS`` bits in at least one part. Every distinct fingerprint is posted under its own parts, and looks up
the small Hamming ball around each part; what meets under a key is verified on all 64 bits. Of two parts that differ in
one bit exactly one has a 0 there, so a ball of radius 1 only has to set bits, never to clear them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.base import lower, over_batches, raw
from tidemark.llm.graph import components
from tidemark.session import settle

WIDTH = 4  # words in a shingle
BITS = 4  # largest Hamming distance of a link
SEGMENTS = 3
SEED = 42
SHORT_RUN = 32  # buckets up to here are compared by shifting the whole batch


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Unsigned XXH64 of every run of ``width`` words, repeats included; a shorter text is one run."""
    words = lower(text).split()
    if not words:
        return np.empty(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= width:
        return np.array([h(join(words), SEED)], np.uint64)
    runs = zip(*(words[i:] for i in range(width)))
    return np.fromiter((h(join(r), SEED) for r in runs), np.uint64, len(words) - width + 1)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as an unsigned number (0 for none)."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, bits long) of whole texts; NULL and blank texts have fingerprint 0."""

    def run(b: pa.RecordBatch) -> dict:
        f = np.array([simhash(shingle_hashes(t, width)) for t in raw(b, "text")], np.uint64)
        return {"doc_id": b.column("doc_id"), "bits": f.view(np.int64)}

    return over_batches(docs.select("doc_id", "text"), "doc_id long, bits long", run)


def cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each part."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def posted(bits: np.ndarray, radius: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and row numbers: each part itself, and the parts of its Hamming ball."""
    keys, rows = [], []
    n = np.arange(len(bits))
    for s, (at, width) in enumerate(cuts(segments)):
        part = (bits >> np.uint64(at)) & np.uint64((1 << width) - 1)
        top = np.uint64(s) << np.uint64(56)
        keys.append(part | top)
        rows.append(n)
        for r in range(1, radius + 1):
            for c in combinations(range(width), r):
                mask = np.uint64(sum(1 << i for i in c))
                # with one bit only 0 -> 1: the other side of the pair stands under its own part
                hit = n if r > 1 else n[(part & mask) == 0]
                keys.append((part[hit] ^ mask) | top)
                rows.append(hit)
    return np.concatenate(keys), np.concatenate(rows)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def bucket_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each key, all that is reachable over distances up to ``bits``.

    Short buckets give all their links; in a long one each fingerprint is reached once (a spanning forest), so a
    dense group of n near copies gives n - 1 links and not n * n / 2.
    """
    a, b = [], []
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    short = np.repeat(size <= SHORT_RUN, size)
    for d in range(1, int(min(size.max(initial=0), SHORT_RUN))):
        i = np.flatnonzero((key[d:] == key[:-d]) & short[:-d])
        if not len(i):
            break
        i = i[_near(fp[i], fp[i + d], bits)]
        a.append(rep[i])
        b.append(rep[i + d])
    for s, n in zip(start[size > SHORT_RUN], size[size > SHORT_RUN]):
        left_f, left_r = fp[s : s + n], rep[s : s + n]
        while len(left_f):
            front = [(left_f[0], left_r[0])]
            left_f, left_r = left_f[1:], left_r[1:]
            while front and len(left_f):
                f, r = front.pop()
                hit = _near(left_f, f, bits)
                if hit.any():
                    got_f, got_r = left_f[hit], left_r[hit]
                    a.append(np.full(len(got_r), r))
                    b.append(got_r)
                    front.extend(zip(got_f, got_r))
                    left_f, left_r = left_f[~hit], left_r[~hit]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    keep = a != b
    return a[keep], b[keep]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as stars: every node points at the smallest one it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    out = low != np.arange(len(nodes))
    return nodes[out], nodes[low[out]]


def links(classes: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): links between the representatives of distinct fingerprints (bits long, rep long), enough to connect
    everything that is connected at Hamming distance ``bits`` or less."""
    radius = bits // segments

    def post(b: pa.RecordBatch) -> dict:
        f = b.column("bits").to_numpy().view(np.uint64)
        rep = b.column("rep").to_numpy()
        key, row = posted(f, radius, segments)
        return {"key": key.view(np.int64), "bits": f[row].view(np.int64), "rep": rep[row]}

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def out(k, f, r):
            a, b = forest(*bucket_links(k, f.view(np.uint64), r, bits))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            k, f, r = (np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("key", "bits", "rep")))
            last = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if last:
                yield out(k[:last], f[:last], r[:last])
            held = [k[last:], f[last:], r[last:]]
        if len(held[0]):
            yield out(*held)

    posts = over_batches(classes.select("bits", "rep"), "key long, bits long, rep long", post)
    return posts.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def near_groups(docs: DataFrame, width: int = WIDTH, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, bits, component_id): fingerprint and smallest doc_id reachable over links, itself included.

    Copies collapse to one row per fingerprint before anything is compared. NULL, empty and blank texts share
    fingerprint 0 and link like any other; repeated rows give repeated rows; a NULL doc_id is ignored as a
    representative; an empty table gives an empty one. Columns besides doc_id and text play no part.
    """
    f = settle(fingerprints(docs, width))
    classes = settle(f.groupBy("bits").agg(F.min("doc_id").alias("rep")))
    named = components(links(classes.where("rep is not null"), bits, segments))
    comp = classes.join(named, classes.rep == named.node, "left").select("bits", F.coalesce("component", "rep").alias("component_id"))
    return f.join(settle(comp), "bits").select("doc_id", "bits", "component_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id, with all its columns.

    Rows that repeat a doc_id are one document: the first by text stays. Rows without doc_id cannot be named, so they stay.
    """
    kept = near_groups(docs.where("doc_id is not null"), **how).where("doc_id = component_id").select(F.col("doc_id").alias("__first")).distinct()
    once = docs.join(kept, docs.doc_id == kept["__first"]).select(docs["*"])
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    once = once.withColumn("__first", first).where("__first = 1").drop("__first")
    return once.unionByName(docs.where("doc_id is null"))


def as_hex(bits: str = "bits"):
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
