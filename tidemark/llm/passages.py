"""Substring de-duplication by hashing units of lines.

A text is cut into lines, a line into its sentences, and a long sentence into pieces whose borders depend on the words
around them alone: a border stands where the hash of the two words beside it is the smallest among its ``REACH``
neighbours on both sides. So a passage that is pasted into the middle of a sentence is cut as in the text that it came
from, but for a few words at its ends, and no piece has fewer than ``REACH`` + 1 words. Every unit is normalised (A-Z
lower-cased, blanks collapsed) and digested. Digests are grouped over the whole corpus; the occurrence with the smallest
(doc_id, position) stays, the others are repeats. Repeats are removed where they stand in a row of ``MIN_WORDS`` words or
more, while short phrases that texts share by chance stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.base import WORD, over_batches

MIN_WORDS = 20  # words of neighbouring repeated units from which they are removed
REACH = 4  # borders inside a sentence are further apart than this, and this far from its ends
TOGETHER = 1 << 20  # characters of texts whose words are held at a time
NAMELESS = (1 << 63) - 1  # rows without doc_id come last

_CUT = re.compile(r"\n|(?<=[.!?])[ \t\r\f\v]+")
_WORD = re.compile(WORD)


def borders(words: list[bytes], sizes: list[int]) -> np.ndarray:
    """Places (numbers of the word before) of the borders inside sentences of ``sizes`` words that stand one after another."""
    n = len(words)
    if n < 2 * REACH + 2:
        return np.zeros(0, np.int64)
    c = np.fromiter(map(crc32, words), np.uint64, n)
    h = (c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    low = h[REACH : len(h) - REACH]
    ok = sentence[: n - 2 * REACH - 1] == sentence[2 * REACH + 1 :]
    for k in range(1, REACH + 1):
        ok &= (low < h[REACH - k : len(h) - REACH - k]) & (low <= h[REACH + k : len(h) - REACH + k])
    return np.flatnonzero(ok) + REACH


def units(texts: Iterable[str | None], placed: bool = True) -> Iterator[list[tuple[int, int, bytes, int]]]:
    """(start, end, digest, words) of each unit, text by text; spans are in characters, end includes the blanks that cut.

    A unit without words has an empty digest. Without ``placed`` units inside a sentence have the span of the sentence.
    Texts are cut up together, as many as make ``TOGETHER`` characters.
    """
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= TOGETHER:
            yield from _units(group, placed)
            group, size = [], 0
    yield from _units(group, placed)


def _units(texts: list[str | None], placed: bool) -> list[list[tuple[int, int, bytes, int]]]:
    cut, words, sizes = [], [], []
    for text in texts:
        text, at, own = text or "", 0, []
        for m in _CUT.finditer(text):
            own.append((at, m.start(), m.end()))
            at = m.end()
        if at < len(text):
            own.append((at, len(text), len(text)))
        for a, b, _ in own:
            w = text[a:b].encode("utf-8", "surrogatepass").lower().split()
            words += w
            sizes.append(len(w))
        cut.append(own)
    inside = borders(words, sizes).tolist()
    inside.append(len(words))
    digest, blank = xxhash.xxh3_128_digest, b" ".join
    out, first, i, j = [], 0, 0, 0
    for text, own in zip(texts, cut):
        parts = []
        for a, b, end in own:
            last = first + sizes[i]
            i += 1
            if inside[j] >= last:
                parts.append((a, end, digest(blank(words[first:last])) if last > first else b"", last - first))
            else:
                starts = [m.start() for m in _WORD.finditer(text, a, b)] if placed else None
                at, start = first, a
                while at < last:
                    stop = inside[j] + 1 if inside[j] < last else last
                    j += stop < last
                    till = end if stop == last or not placed else starts[stop - first]
                    parts.append((start, till, digest(blank(words[at:stop])), stop - at))
                    at, start = stop, till if placed else a
            first = last
        out.append(parts)
    return out


def removed_spans(parts: list[tuple[int, int, bytes, int]], known: set[bytes], min_words: int) -> list[tuple[int, int]]:
    """Spans of neighbouring repeats with ``min_words`` words or more; ``known``: digests whose first place is elsewhere.

    A unit that stood in this text before is a repeat too; units without words join the repeats on both sides.
    """
    seen: set[bytes] = set()
    out, first, last, words = [], -1, -1, 0
    for start, end, d, n in [*parts, (0, 0, b"end", 0)]:
        if not d:
            continue
        if d in known or d in seen:
            if first < 0:
                first = start
            last, words = end, words + n
        else:
            if first >= 0 and words >= min_words:
                out.append((first, last))
            first, words = -1, 0
        seen.add(d)
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS))


def _part() -> Column:
    """Tells rows without doc_id apart by their text, so that what is known of them is gathered text by text."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))


def unit_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, part, a, b): the 128-bit digest of each unit, once per row of ``docs``."""

    def run(batch: pa.RecordBatch) -> dict:
        counts, digests = [], []
        for parts in units(batch.column("text").to_pylist(), placed=False):
            own = {d for _, _, d, _ in parts if d}
            counts.append(len(own))
            digests += own
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        rows = np.repeat(np.arange(len(counts)), counts)
        return {"doc_id": batch.column("doc_id").take(pa.array(rows)), "part": batch.column("part").take(pa.array(rows)), "a": d[:, 0], "b": d[:, 1]}

    return over_batches(docs.select(_id().alias("doc_id"), _part().alias("part"), "text"), "doc_id long, part long, a long, b long", run)


def known_elsewhere(docs: DataFrame) -> DataFrame:
    """(doc_id, part, known): digests of a document whose first place is an earlier document.

    Places are counted before the shuffle and only the smallest doc_id of a digest goes on, so a unit that a third of
    all documents share is one row per task; its join with the documents that hold it is skewed, and AQE splits it.
    """
    d = unit_digests(docs)
    first = d.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("a", "b", "first")
    later = d.join(first, ["a", "b"]).where("doc_id > first")
    return later.groupBy("doc_id", "part").agg(F.collect_set(F.struct("a", "b")).alias("known"))


def spans(docs: DataFrame, min_words: int = MIN_WORDS, keep: list[str] = ()) -> DataFrame:
    """(doc_id, n_units, removed, text): what is cut from every document, and what is left of it.

    ``removed`` has the spans in characters of the original text, ``text`` is the rest (NULL stays NULL). Rows of one
    doc_id are one document: equal units in them are not repeats of each other, unless within one row. Rows without
    doc_id come after all others, as one document. Empty texts and empty tables give no spans. ``keep`` names columns of
    ``docs`` to carry along; other columns, also ones named like the results, are not read.
    """
    carried = [F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _id().alias("__id"), _part().alias("__part"), *carried)
    k = known_elsewhere(docs).withColumnsRenamed({"doc_id": "__id", "part": "__part"})
    joined = d.join(k, ["__id", "__part"], "left").drop("__id", "__part")

    def run(batch: pa.RecordBatch) -> dict:
        n, cut, rest = [], [], []
        texts = batch.column("text").to_pylist()
        for t, parts, known in zip(texts, units(texts), batch.column("known").to_pylist()):
            there = {np.array([x["a"], x["b"]], np.int64).tobytes() for x in known or ()}
            s = removed_spans(parts, there, min_words)
            n.append(len(parts))
            cut.append([{"start": a, "end": b} for a, b in s])
            rest.append(without(t, s) if s else t)
        return {"doc_id": batch.column("doc_id"), "n_units": n, "removed": cut, "text": rest, **{f"__keep_{i}": batch.column(f"__keep_{i}") for i in range(len(keep))}}

    types = "".join(f", __keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return over_batches(joined, "doc_id long, n_units long, removed array<struct<start: int, end: int>>, text string" + types, run)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from the text; n_chars follows the text.

    A document whose words were all repeats goes; every other row stays.
    """
    cols = [c for c in docs.columns if c != "text"]
    s = spans(docs, min_words, cols)
    gone = (F.size("removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    out = {c: F.col(f"__keep_{i}") for i, c in enumerate(cols)} | {"text": F.col("text")}
    if "n_chars" in cols:
        same = F.size("removed") == 0
        out["n_chars"] = F.when(same, out["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return s.where(~gone).select(*(out[c].alias(c) for c in docs.columns))
