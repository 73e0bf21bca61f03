"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Weights come from follow-the-regularised-leader steps with L1 and L2 penalties. The drawn training texts are dealt over
a fixed number of shards; each shard goes on from the common state, and after every pass the states are averaged. One
temperature, fitted on drawn texts that were not trained on, makes the class probabilities honest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.base import fold, over_batches
from tidemark.session import settle

BITS = 16  # 2 ** BITS hashed features
GRAMS = (1, 2, 3)
MAX_ROWS = 16384  # training texts drawn in all, by hash of the id, in equal parts a language
SHARDS = 8
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
FOLDS = 3  # documents with crc32(doc_id) mod 3 = 1 are held out
HELD = 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased whole text, blanks as one sort of character, with their counts."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where(c <= 32, np.uint64(32), c)
    found = []
    for n in GRAMS:
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ c[i : len(c) - n + 1 + i]) * MIX
            h ^= h >> np.uint64(29)
        found.append((h * MIX) >> np.uint64(64 - BITS))
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    all_ = np.concatenate(found).astype(np.int64)
    if len(all_) < 2000:
        i, n = np.unique(all_, return_counts=True)
        return i, n.astype(float)
    n = np.bincount(all_, minlength=1 << BITS)
    i = np.flatnonzero(n)
    return i, n[i].astype(float)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Over all texts: in how many each hashed feature occurs. Tasks send one row a feature at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                for t in b.column("text").slice(i, 512).to_pylist():
                    df[features(t)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["f", "n"])

    rows = texts.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << BITS)
    for r in rows:  # at most 2 ** BITS
        out[r.f] = r.n
    return out


def weighted(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of unit length."""
    i, n = features(text)
    v = n * idf[i]
    norm = np.sqrt((v * v).sum())
    return i, v / norm if norm else v


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def proximal(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a state: zero where |z| does not pass the L1 penalty."""
    return -np.sign(z) * np.maximum(np.abs(z) - L1, 0.0) / ((BETA + np.sqrt(n)) / ALPHA + L2)


def ftrl_pass(rows: Iterable[tuple[str, int]], idf: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """One pass over (text, class), in place."""
    for text, k in rows:
        i, v = weighted(text, idf)
        zi, ni = z[i], n[i]
        w = proximal(zi, ni)
        p = softmax(v @ w)
        p[k] -= 1.0
        g = v[:, None] * p[None, :]
        step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[i] = zi + g - step * w
        n[i] = ni + g * g


def drawn_texts(docs: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """(text, label, shard, part) of at most about ``most`` rows, and the languages by label."""
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return docs.limit(0).selectExpr("text", "0 AS label", "0 AS shard", "0 AS part", "0L AS h"), langs
    each = max(1, most // len(langs))
    h = F.xxhash64(F.lit("langid"), "doc_id")
    unit = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, each / sizes[k])))])[F.col("lang")]
    label = F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))])[F.col("lang")]
    deal = F.pmod(F.xxhash64(F.lit("deal"), "doc_id"), F.lit(SHARDS * 5)).cast("int")
    drawn = docs.where(unit < share).select("text", label.alias("label"), (deal % SHARDS).alias("shard"), F.floor(deal / SHARDS).cast("int").alias("part"), h.alias("h"))
    return settle(drawn), langs


def fit(docs: DataFrame, most: int = MAX_ROWS) -> dict:
    """A model from (doc_id, text, lang): languages, weights (IDF included) and temperature."""
    drawn, langs = drawn_texts(docs, most)
    idf = np.zeros(1 << BITS)
    model = {"langs": langs, "idf": idf, "w": np.zeros((1 << BITS, len(langs))), "t": 1.0}
    if not langs:
        return model
    df = document_frequencies(docs)
    idf[:] = np.log((1 + docs.count()) / (1 + df)) + 1
    z, n = np.zeros((1 << BITS, len(langs))), np.zeros((1 << BITS, len(langs)))
    sc = docs.sparkSession.sparkContext
    for _ in range(PASSES):
        state = sc.broadcast((z, n, idf))

        def shard(pdf: pd.DataFrame) -> pd.DataFrame:
            z0, n0, idf0 = state.value
            z1, n1 = z0.copy(), n0.copy()
            pdf = pdf.sort_values(["h", "text"])
            ftrl_pass(zip(pdf["text"], pdf["label"]), idf0, z1, n1)
            at = np.flatnonzero((n1 != n0).any(axis=1))
            return pd.DataFrame({"f": [at.tobytes()], "z": [z1[at].tobytes()], "n": [n1[at].tobytes()]})

        got = drawn.where("part > 0").groupBy("shard").applyInPandas(shard, "f binary, z binary, n binary").collect()
        dz, dn = np.zeros_like(z), np.zeros_like(n)
        for r in got:  # SHARDS states
            at = np.frombuffer(r.f, np.int64)
            dz[at] += np.frombuffer(r.z).reshape(-1, len(langs)) - z[at]
            dn[at] += np.frombuffer(r.n).reshape(-1, len(langs)) - n[at]
        z, n = z + dz / max(len(got), 1), n + dn / max(len(got), 1)
        state.destroy()
    model["w"] = proximal(z, n)
    model["t"] = temperature(drawn.where("part = 0"), model)
    return model


def logits(docs: DataFrame, model: dict, keep: str) -> DataFrame:
    """(keep, z array<double>) of whole texts."""
    shipped = docs.sparkSession.sparkContext.broadcast((model["idf"], model["w"]))
    name = keep.split()[0]

    def start():
        idf, w = shipped.value

        def one(t):
            i, v = weighted(t, idf)
            return v @ w[i]

        return lambda b: {name: b.column(name), "z": [one(t) for t in b.column("text").to_pylist()]}

    return over_batches(docs.select(name, "text"), f"{keep}, z array<double>", None, start)


def temperature(held: DataFrame, model: dict) -> float:
    """What to divide the logits by for the least log loss on texts that were not trained on."""
    rows = logits(held, model, "label int").collect()
    if not rows:
        return 1.0
    z, y = np.array([r.z for r in rows]), np.array([r.label for r in rows])
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-300)).mean()
    grid = np.exp(np.linspace(np.log(0.01), np.log(10), 200))
    return float(min(grid, key=loss))


def languages(docs: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    Learned from rows outside the held-out fold with a language; a NULL doc_id is in no fold, so it is neither held out
    nor learned from. A text that is NULL or has no letter is ``und`` with score 0, as is every text when nothing could
    be learned. Equal probabilities go to the first language in code point order. Columns besides doc_id, text and lang
    are not read; repeated rows get equal results.
    """
    model = fit(docs.where((fold("doc_id", FOLDS) != HELD) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), most)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shipped.value

        def one(t: str | None) -> tuple[str, float]:
            if not t or not m["langs"] or not any(map(str.isalpha, t)):
                return "und", 0.0
            i, v = weighted(t, m["idf"])
            p = softmax((v @ m["w"][i]) / m["t"])
            k = int(p.argmax())
            return m["langs"][k], float(p[k])

        def run(b: pa.RecordBatch) -> dict:
            got = [one(t) for t in b.column("text").to_pylist()]
            return {"doc_id": b.column("doc_id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return run

    out = over_batches(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double", None, start)
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
