"""Quality rules: counts over whole texts, judged by an isolation forest.

Random splits cut a small subsample until every row stands alone; a document whose statistics are reached after few
splits is unusual. The path lengths over all trees give a score in (0, 1), and the labelled rows say from which score
on unusual means bad.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.base import SLICE, over_batches, raw
from tidemark.session import settle

TREES = 128
SUBSAMPLE = 256  # rows of a tree, drawn from a pool of at most TREES * SUBSAMPLE rows, taken by hash of the id
SHARE = 4  # a tree draws at most one in so many rows of the pool, so that copies of a fault do not hide each other
GOOD_COST = 20.0  # losing a good labelled row costs as much as keeping so many bad ones (as shares of their classes)
BINS = 1000
THIN = 1 << 40
SEED = 20
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_short", "n_stops", "n_top"]
FEATURES = ["mean_word", "symbol_share", "short_share", "stop_share", "top_share"]

_NOT_CHARS = bytes(range(0x80, 0xC0)) + b" \t\n\v\f\r"  # bytes that start no character of a word


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that stand in the text at least twice."""
    if len(words) < 4:
        return 0
    runs = list(zip(words, words[1:], words[2:]))
    seen = Counter(runs)
    if len(seen) == len(runs):
        return 0
    hit = np.fromiter((seen[r] > 1 for r in runs), bool, len(runs))
    full = np.zeros(len(words), bool)
    for d in range(3):
        full[d : d + len(runs)] |= hit
    return int(full.sum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The values of STATS for one text; NULL is empty.

    n_short: words of at most 3 bytes; n_stops: full stops and commas; n_top: occurrences of the commonest word.
    """
    text = text or b""
    words = text.split()  # bytes split at exactly the six blanks
    lines = text.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for x in lines:
            dup += x in seen and bool(x.strip())
            seen.add(x)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    chars = len(text.translate(None, _NOT_CHARS))
    short = sum(len(w) <= 3 for w in words)
    stops = text.count(b".") + text.count(b",")
    top = max(Counter(words).values(), default=0)
    return len(words), chars, symbols, dup, repeat_words(words), short, stops, top


def rule_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS...) of every whole text, one row per row."""

    def run(b: pa.RecordBatch) -> dict:
        cols = zip(*map(statistics, raw(b, "text"))) if b.num_rows else [[]] * len(STATS)
        return {"doc_id": b.column("doc_id"), **{k: list(v) for k, v in zip(STATS, cols)}}

    return over_batches(docs.select("doc_id", "text"), "doc_id long, " + ", ".join(f"{s} long" for s in STATS), run)


def features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "mean_word": F.col("word_chars") / F.greatest("n_words", F.lit(1)),
        "symbol_share": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "short_share": F.col("n_short") / F.greatest("n_words", F.lit(1)),
        "stop_share": F.col("n_stops") / F.greatest("n_words", F.lit(1)),
        "top_share": F.col("n_top") / F.greatest("n_words", F.lit(1)),
    })


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature or -1, cut, left, right, length) in order of their numbers; the root is 0."""
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        free = np.flatnonzero(low < high)
        if depth >= limit or len(rows) <= 1 or not len(free):
            nodes[at] = (-1, 0.0, 0, 0, depth + mean_path(len(rows)))
            continue
        f = int(rng.choice(free))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[rows, f] < cut
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1, 0.0)
        todo += [(len(nodes), rows[left], depth + 1), (len(nodes) + 1, rows[~left], depth + 1)]
        nodes += [None, None]
    return nodes


def draw(pool: np.ndarray, tree: int, subsample: int = SUBSAMPLE, seed: int = SEED) -> tuple[np.ndarray, np.random.Generator]:
    """The rows of one tree, drawn without replacement, and the generator that goes on to cut them."""
    rng = np.random.default_rng([seed, tree])
    return pool[np.sort(rng.choice(len(pool), tree_rows(len(pool), subsample), replace=False))], rng


def tree_rows(pool: int, subsample: int = SUBSAMPLE) -> int:
    """Rows of a tree: ``subsample``, or a share of a small pool, two at least."""
    return min(pool, subsample, max(2, -(-pool // SHARE)))


def fit_forest(stats: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> tuple[list[np.ndarray], int]:
    """The trees, grown by the executors from a hash sample of at most ``trees * subsample`` rows, and the rows of each.

    Every tree draws its rows from the sample for itself.
    """
    by = F.xxhash64(F.lit(seed), "doc_id", *STATS)
    most, n = trees * subsample, stats.count()
    # Thinned by hash before it is sorted, or every task would send its own ``most`` rows.
    share = math.ceil(THIN * min(1.0, 1.1 * most / max(n, 1)))
    thin = features(stats).select(by.alias("h"), *FEATURES).where(F.pmod("h", F.lit(THIN)) < share)
    drawn = thin.orderBy("h", *FEATURES).limit(most).toPandas()
    pool = drawn.sort_values(["h", *FEATURES])[FEATURES].to_numpy(float)  # 5 numbers a row: under 2 MB
    size = tree_rows(len(pool), subsample)
    if size < 2:
        return [], size
    limit = int(np.ceil(np.log2(size)))

    def some(frames):
        for f in frames:
            for t in f["id"]:
                x, rng = draw(pool, t, subsample, seed)
                out = pd.DataFrame(grow(x, rng, limit), columns=["f", "cut", "l", "r", "len"])
                yield out.assign(tree=t, node=range(len(out)))

    ids = stats.sparkSession.range(trees)
    nodes = ids.mapInPandas(some, "f int, cut double, l int, r int, len double, tree int, node int").toPandas()
    return [g.sort_values("node")[["f", "cut", "l", "r", "len"]].to_numpy() for _, g in nodes.groupby("tree")], size


def forest_score(x: np.ndarray, forest: list[np.ndarray], subsample: int) -> np.ndarray:
    """2 ** -(mean path / expected path): near 1 for rows that stand alone early; 0 without a forest."""
    if not forest:
        return np.zeros(len(x))
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in forest:
        f, cut, left, right, length = t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]
        at = np.zeros(len(x), int)
        while (f[at] >= 0).any():
            inner = f[at] >= 0
            low = x[rows, np.maximum(f[at], 0)] < cut[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        total += length[at]
    return 2.0 ** (-total / len(forest) / mean_path(subsample))


def scored(stats: DataFrame, forest: list[np.ndarray], size: int) -> DataFrame:
    """``stats`` with ``score``; 0 where there is no forest."""
    f = features(stats).select("doc_id", *STATS, *FEATURES)

    def run(b: pa.RecordBatch) -> dict:
        x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES])
        return {**{c: b.column(c) for c in ["doc_id", *STATS]}, "score": forest_score(x, forest, size)}

    return over_batches(f, "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", score double", run)


def best_cut(counts: dict[tuple[int, int], int], good_cost: float = GOOD_COST) -> float | None:
    """The score from which a row is rejected; None (reject none) unless the labels favour one.

    ``counts`` has labelled rows by (score bin, quality). Of equally good cuts the highest counts.
    """
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for (b, q), n in counts.items():
        (good if q else bad)[b] += n
    if not good.sum() or not bad.sum():
        return None
    lost = lambda v: (v[::-1].cumsum()[::-1]) / v.sum()  # noqa: E731  share of rows in this bin or above
    gain = lost(bad) - good_cost * lost(good)
    b = BINS - int(np.argmax(gain[::-1]))
    return b / BINS if gain[b] > 0 else None


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fit(docs: DataFrame, labels: DataFrame, trees: int, subsample: int) -> tuple[DataFrame, list[np.ndarray], int, float | None]:
    """Scored statistics of ``docs``, the forest with its rows a tree, and the cut."""
    stats = settle(rule_counts(docs))
    forest, size = fit_forest(stats.where(~_failed()), trees, subsample)
    s = settle(scored(stats, forest, size))
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bins = s.where(~_failed()).join(known, "doc_id").groupBy(F.floor(F.col("score") * BINS).cast("int").alias("b"), (F.col("quality") > 0).cast("int").alias("q")).count()
    return s, forest, size, best_cut({(r.b, r.q): r["count"] for r in bins.collect()})  # at most 2 * (BINS + 1) rows


def judged(docs: DataFrame, labels: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_short, n_stops, n_top, score, base_failed, kept).

    ``labels`` has (doc_id, quality); a document labelled twice counts with its lower value, NULL labels play no part.
    The forest samples rows that pass the base rule. A NULL or blank text fails the base rule; repeated rows give
    repeated results, rows without doc_id are judged like any other; equal scores share a verdict; without rows of both
    labels nothing but the base rule rejects. Columns of ``docs`` besides doc_id and text are not read.
    """
    s, _, _, cut = _fit(docs, labels, trees, subsample)
    good = F.lit(True) if cut is None else F.floor(F.col("score") * BINS) < round(cut * BINS)
    return s.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & good)


def keep_good(docs: DataFrame, labels: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """The documents that the rules and the forest keep, with all their columns.

    Forest and cut are fitted first; then every row is judged by its own text where it is read, so nothing is joined or
    shuffled. Rows without doc_id and rows that repeat one are judged like any other.
    """
    _, forest, size, cut = _fit(docs, labels, trees, subsample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, SLICE):
                b = big.slice(i, SLICE)
                v = np.array([statistics(t) for t in raw(b, "text")], float).reshape(-1, len(STATS))
                n, chars, symbols, _, repeats, short, stops, top = v.T
                ok = (n >= 50) & (100 * repeats <= 50 * n)
                if cut is not None and ok.any():
                    per = np.maximum(n, 1)
                    x = np.column_stack([chars / per, symbols / np.maximum(chars, 1), short / per, stops / per, top / per])
                    ok &= np.floor(forest_score(x, forest, size) * BINS) < round(cut * BINS)
                yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
