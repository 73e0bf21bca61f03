"""Toxicity by two class-conditional Kneser-Ney models over the characters of words.

Both models share their lower orders: continuation counts of all training texts. Only the highest order is counted per
class, so an expression that neither class has seen falls back to the same shared estimate twice and moves no score.
Most words of a toxic text are ordinary, so a document counts what stands out: the part of each word's log-likelihood
ratio, toxic against ordinary, above a margin, per word. Margin and the logistic curve that puts this on a probability
scale are fitted on labelled rows that were not counted.
"""

from __future__ import annotations

from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.base import fold, over_batches
from tidemark.session import settle

ORDER = 4  # characters of an n-gram
DISCOUNT = 0.75
MAX_PER_CLASS = 8192  # labelled rows of a class that are drawn for fitting, by hash of the id
CACHED = 1 << 18  # words with their ratios held by a process
MARGINS = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)  # tried on the calibration part
FOLDS = 5  # documents with crc32(doc_id) mod 5 = 0 are held out
START, STOP = "\x02", "\x03"


def grams(word: str, order: int = ORDER) -> list[str]:
    s = START * (order - 1) + word + STOP
    return [s[i : i + order] for i in range(len(word) + 1)]


def doc_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


class SharedKneserNey:
    """log P(toxic) - log P(ordinary) of n-grams, from counts (gram, class) -> n of the highest order."""

    def __init__(self, counts: dict[tuple[str, int], int], order: int = ORDER, discount: float = DISCOUNT):
        self.order, self.discount = order, discount
        self.top = [{g: n for (g, c), n in counts.items() if c == k} for k in (0, 1)]
        self.top_sums = [self._sums(t) for t in self.top]
        self.lower: dict[int, Counter] = {}
        longer = {g for g, _ in counts}
        for m in range(order - 1, 0, -1):
            self.lower[m] = Counter(g[1:] for g in longer)  # different characters in front
            longer = set(self.lower[m])
        self.lower_sums = {m: self._sums(c) for m, c in self.lower.items()}
        self.uniform = 1.0 / (len(self.lower.get(1, ())) + 1)
        self.known: dict[str, float] = {}

    @staticmethod
    def _sums(counts: dict[str, int]) -> dict[str, tuple[int, int]]:
        """Context: (counts, kinds)."""
        out: dict[str, tuple[int, int]] = {}
        for g, n in counts.items():
            a, b = out.get(g[:-1], (0, 0))
            out[g[:-1]] = (a + n, b + 1)
        return out

    def shared(self, g: str) -> float:
        if not g:
            return self.uniform
        low = self.shared(g[1:])
        total, kinds = self.lower_sums[len(g)].get(g[:-1], (0, 0))
        if not total:
            return low
        return (max(self.lower[len(g)].get(g, 0) - self.discount, 0.0) + self.discount * kinds * low) / total

    def prob(self, k: int, g: str) -> float:
        low = self.shared(g[1:])
        total, kinds = self.top_sums[k].get(g[:-1], (0, 0))
        if not total:
            return low
        return (max(self.top[k].get(g, 0) - self.discount, 0.0) + self.discount * kinds * low) / total

    def ratio(self, g: str) -> float:
        got = self.known.get(g)
        if got is None:
            got = log(self.prob(1, g) / self.prob(0, g))
            if len(self.known) < 4 * CACHED:
                self.known[g] = got
        return got

    def word(self, word: str) -> float:
        return sum(map(self.ratio, grams(word, self.order)))


class _Words(dict):
    def __init__(self, model: SharedKneserNey):
        self.model = model

    def __missing__(self, w: str) -> float:
        if len(self) >= CACHED:
            self.clear()
        got = self[w] = self.model.word(w)
        return got


def text_ratio(words: list[str], by_word: dict[str, float], margin: float) -> float:
    """What the words' log-likelihood ratios have above ``margin``, per word; 0 without words."""
    return sum(r - margin for r in map(by_word.__getitem__, words) if r > margin) / len(words) if words else 0.0


def gram_counts(texts: DataFrame, order: int = ORDER) -> dict[tuple[str, int], int]:
    """Counts over (text, label); a text counts each of its words once. The texts are a bounded sample."""

    def run(b: pa.RecordBatch) -> dict:
        c: Counter = Counter()
        for t, k in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
            c.update((g, k) for w in set(doc_words(t)) for g in grams(w, order))
        return {"gram": [g for g, _ in c], "label": [k for _, k in c], "n": list(c.values())}

    rows = over_batches(texts.select("text", "label"), "gram string, label int, n long", run).groupBy("gram", "label").agg(F.sum("n").alias("n"))
    return {(r.gram, r.label): r.n for r in rows.toLocalIterator()}


def ratios(docs: DataFrame, model: SharedKneserNey, margins: tuple[float, ...], keep: str = "doc_id long") -> DataFrame:
    """(doc_id, ratios) of whole texts, one ratio a margin."""
    name = keep.split()[0]
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was counted on

    def start():
        by = _Words(shipped.value)

        def run(b: pa.RecordBatch) -> dict:
            split = map(doc_words, b.column("text").to_pylist())
            return {name: b.column(name), "ratios": [[text_ratio(w, by, m) for m in margins] for w in split]}

        return run

    return over_batches(docs.select(name, "text"), f"{keep}, ratios array<double>", None, start)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, offset) of the weighted logistic curve by Newton steps."""
    z = np.column_stack([x, np.ones_like(x)])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (w * (y - p)) - ridge * b
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), g)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def best_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[int, float, float]:
    """(column of ``x``, slope, offset) of the curve over the root of one column that explains ``y`` best; of equal ones the first.

    The root keeps a few glaring texts from pulling the curve away from those with one or two such words.
    """
    found = []
    for i, c in enumerate(np.sqrt(x).T):
        slope, offset = logistic(c, y, w)
        found.append((float((w * np.logaddexp(0, np.where(y == 1, -1, 1) * (c * slope + offset))).sum()), i, slope, offset))
    return min(found)[1:]


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, label, part) of at most ``most`` labelled rows a class outside the held-out fold, and the class sizes.

    A document labelled twice counts with its higher value. Of equal texts one is used.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    known = settle(known.where(fold("doc_id", FOLDS) != 0))
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    h = F.xxhash64(F.lit("toxicity"), "doc_id")
    drawn = [known.where(F.col("label") == k).withColumn("h", h).orderBy("h", "doc_id").limit(most) for k in sizes]
    if not drawn:
        return docs.limit(0).selectExpr("text", "0 AS label", "0 AS part"), sizes
    ids = drawn[0]
    for d in drawn[1:]:
        ids = ids.unionAll(d)
    ids = settle(ids.select(F.col("doc_id").alias("__id"), "label", F.pmod("h", F.lit(4)).cast("int").alias("part")))
    # at most 2 * most rows of 16 bytes
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    return settle(texts.groupBy(F.xxhash64("text").alias("t"), "label").agg(F.first("text").alias("text"), F.min("part").alias("part")).drop("t")), sizes


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, ratio, score, predicted) of every row of ``docs``.

    Labels are learned only outside the held-out fold; three quarters of the drawn texts are counted, one quarter fits
    the margin and the curve, with the classes weighted to their true sizes. Without rows of both classes every score is 0. NULL and
    blank texts have ratio 0; a NULL doc_id is not held out; repeated rows give repeated scores. Only doc_id and text
    of ``docs`` are read.
    """
    sample, sizes = labelled_sample(docs, labels, most)
    held = F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out")
    model = SharedKneserNey(gram_counts(sample.where("part > 0")))
    calibration = sample.where("part = 0").withColumn("label", F.col("label").cast("long"))
    fitted = [(r.label, r.ratios) for r in ratios(calibration, model, MARGINS, "label long").collect()]
    y, x = np.array([k for k, _ in fitted], float), np.array([v for _, v in fitted]).reshape(-1, len(MARGINS))
    if len(set(y)) < 2:
        out = ratios(docs, model, MARGINS[:1]).select("doc_id", F.col("ratios")[0].alias("ratio"))
        return out.select("doc_id", held, "ratio", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    share = {k: sizes[k] / max((y == k).sum(), 1) for k in (0, 1)}
    w = np.where(y == 1, share[1], share[0])
    best, slope, offset = best_curve(x, y, w / w.mean())
    out = ratios(docs, model, MARGINS[best : best + 1]).select("doc_id", F.col("ratios")[0].alias("ratio"))
    score = 1 / (1 + F.exp(-(F.sqrt("ratio") * slope + offset)))
    return out.select("doc_id", held, "ratio", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
