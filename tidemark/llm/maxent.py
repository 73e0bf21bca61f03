"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) P(word | class, context). The commonest ``OUT`` words stand in classes of
``SLOTS`` words by rank; all other words fall into ``RARE`` classes by their ending, inside which smoothed corpus counts
decide. Class and word scores are sums of weights that hashed n-gram and skip features of the context select. Training
goes over all training documents once, in ``ROUNDS`` parts: each task starts from the common weights, takes gradient
steps over its own documents, and the tasks' weights are averaged. A step moves, for every token, the weights of the
class (word) that was there against those of one drawn from the model, an unbiased estimate of the gradient.

Word counts cover all training documents. Words are known by 64-bit hashes; the ``HEAD`` commonest go to the tasks,
the counts of the others are joined to the documents that hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.base import fold, raw
from tidemark.session import settle

OUT, SLOTS, RARE = 4096, 64, 16
CLASSES = OUT // SLOTS + RARE
ROWS = 1 << 13  # hashed feature rows of either table
HEAD = 1 << 18  # words whose counts every task holds
GROUP = 8  # columns drawn from at a time
CHUNK = 1024  # tokens of a gradient step, or scored at a time
ROUNDS = 4
ENDS = 65  # endings, and none
RATE, DAMP = 0.2, 8.0  # a weight that has moved n times moves by RATE / sqrt(n + DAMP)
SAFE = 60.0  # scores whose exp neither overflows nor vanishes
SPAN = 80.0  # scores less than this apart keep all their digits as products of odds
SLICE = 1 << 20  # bytes of text worked on at a time, or one text
FOLDS, HELD = 5, 1  # documents with crc32(doc_id) mod 5 = 1 teach nothing
PUNCTUATION = ".,;:!?\"'()"
END = b"\n"  # no word can hold it
BLOCKS = 64  # parts in which weights are averaged


def tokens(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words, then one end, of every text: the different words, each token's place among them, and how many
    tokens each text has. The first of the words is the end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or b"" for t in texts], pa.binary()).view(pa.string())))
    found = parts.flatten().dictionary_encode()
    words = pa.concat_arrays([pa.array([END], pa.binary()), found.dictionary.view(pa.binary())])
    at = found.indices.to_numpy() + np.int64(1)
    full = (pc.binary_length(found.dictionary).to_numpy() > 0)[at - 1]  # there is an empty one beside blanks at a border
    sizes = np.bincount(np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy())[full], minlength=len(texts)) + 1
    word = np.ones(int(sizes.sum()), bool)
    word[np.cumsum(sizes) - 1] = False
    out = np.zeros(len(word), np.int64)
    out[word] = at[full]
    return words, out, sizes


def keys_of(words: pa.Array) -> np.ndarray:
    """``key`` of each."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False), repeat(7)), np.uint64, len(words)).view(np.int64)


def key(word: bytes) -> int:
    """Signed 64-bit hash of a word."""
    h = xxhash.xxh64_intdigest(word, 7)
    return h - (1 << 64) if h >> 63 else h


def endings(words: pa.Array) -> np.ndarray:
    """0 to 63, by the last three bytes of each word without punctuation."""
    last = pc.binary_slice(pc.ascii_trim(words.view(pa.string()), PUNCTUATION).view(pa.binary()), -3, None)
    last = pc.if_else(pc.equal(pc.binary_length(last), 0), pc.binary_slice(words, -1, None), last).dictionary_encode()
    return np.array([xxhash.xxh32_intdigest(x, 3) & 63 for x in last.dictionary.to_pylist()], np.int64)[last.indices.to_numpy()]


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, ending, n): how often each token stands in the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _slices(b):
                words, at, _ = tokens(raw(s, "text"))
                n = np.bincount(at, minlength=len(words))
                words, n = words.filter(pa.array(n > 0)), n[n > 0]
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(words)), pa.array(endings(words), pa.int32()), pa.array(n)], names=["key", "ending", "n"])

    rows = docs.select("text", _size()).mapInArrow(run, "key long, ending int, n long")
    return rows.groupBy("key", "ending").agg(F.sum("n").alias("n"))


class Counts:
    """Totals of a count table and its commonest words, in order of their counts."""

    def __init__(self, counts: DataFrame):
        level = F.floor(F.log2("n") * 16).cast("int")
        total = counts.agg(F.sum("n"), F.count("*")).first()
        self.n, self.kinds = int(total[0] or 0), int(total[1])
        room, least = HEAD, None
        for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # one row a level
            room -= r["count"]
            if room < 0:
                break
            least = r.level
        head = counts.where(level >= least) if least is not None else counts.limit(0)  # HEAD rows at most
        top = head.toPandas().sort_values(["n", "key"], ascending=[False, True])
        self.keys, self.head_n, self.head_end = (top[c].to_numpy(np.int64) for c in ("key", "n", "ending"))
        self.out = min(OUT, len(self.keys))
        rare = counts.groupBy((F.col("ending") % RARE).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        self.rare_n, self.rare_v = np.zeros(RARE), np.zeros(RARE)
        for r in rare:
            self.rare_n[r.k], self.rare_v[r.k] = r.n, r.v
        for e, n in zip(self.head_end[: self.out] % RARE, self.head_n[: self.out]):
            self.rare_n[e] -= n
            self.rare_v[e] -= 1


class Keys(dict):
    """word: its key, for words outside the head."""

    def __missing__(self, w: bytes) -> int:
        return key(w)


class Vocabulary:
    """Places of keys in the head."""

    def __init__(self, keys: np.ndarray):
        self.place = np.argsort(keys)
        self.sorted, self.tail, self.keys_of = keys[self.place], Keys(), keys

    def codes(self, words: pa.Array) -> np.ndarray:
        """Words: (place in the head, or -1) * 256 + ending."""
        keys, place = keys_of(words), np.full(len(words), -1)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
            place = np.where(self.sorted[at] == keys, self.place[at], -1)
        return place << 8 | endings(words)


_held: list[Vocabulary] = []  # of this Python worker: tasks of one model go on from what earlier ones sorted


def vocabulary(keys: np.ndarray) -> Vocabulary:
    if not _held or _held[0].keys_of is not keys:
        _held[:] = [Vocabulary(keys)]
    return _held[0]


def hashed(*parts: np.ndarray | int) -> np.ndarray:
    out = np.full(1, 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        out = (out ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(31))
    # the top bits number the rows; row 0 is the bias
    return np.maximum((out >> np.uint64(65 - ROWS.bit_length())).astype(np.int64), 1)


# Rows of the features of small domains, looked up instead of hashed at every token: one word in front, two or three back;
# an ending one or two back with the class; the word in front with the class.
_IDENT, _END, _CLS = np.arange(OUT + ENDS), np.arange(ENDS), np.arange(CLASSES)
WORD_ROWS = [hashed(k, _IDENT).astype(np.int32) for k in (1, 4, 5)]
END_ROWS = hashed(2, _END).astype(np.int32)
END_CLASS_ROWS = [hashed(k, _END[:, None], _CLS).astype(np.int32).ravel() for k in (7, 8)]
WORD_CLASS_ROWS = hashed(9, _IDENT[:, None], _CLS).astype(np.int32).ravel()


def events(codes: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Classes, slots and feature rows of the tokens of several texts in a row; ``starts``: first token of each."""
    place, end = codes >> 8, codes & 255
    known = (place >= 0) & (place < OUT)
    ident = np.where(known, place, OUT + end)
    cls = np.where(known, place // SLOTS, OUT // SLOTS + end % RARE)
    slot = np.where(known, place % SLOTS, 0)
    left = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))  # tokens in front

    def back(x, k, none):
        out = np.full(len(x), none, np.int64)
        out[k:] = x[:-k] if k < len(x) else x[:0]
        out[left < k] = none
        return out

    i1, i2, i3 = (back(ident, k, OUT + 64) for k in (1, 2, 3))
    e1, e2 = (back(end, k, 64) for k in (1, 2))
    top, inner = np.empty((5, len(codes)), np.int64), np.empty((3, len(codes)), np.int64)
    top[0], top[1], top[2] = WORD_ROWS[0][i1], END_ROWS[e1], hashed(3, i1, i2)
    top[3], top[4] = WORD_ROWS[1][i2], WORD_ROWS[2][i3]
    inner[0], inner[1] = END_CLASS_ROWS[0][e1 * CLASSES + cls], END_CLASS_ROWS[1][e2 * CLASSES + cls]
    inner[2] = WORD_CLASS_ROWS[i1 * CLASSES + cls]
    return {"cls": cls, "slot": slot, "known": known, "top": top, "inner": inner, "before": i1, "end": e1}


class Sums(NamedTuple):
    """Scores that share contexts, summed, and the weights to add to them; or the exp of all, where ``odds`` multiplies."""

    after: np.ndarray
    inside: np.ndarray
    top: np.ndarray
    inner: np.ndarray
    odds: Callable


class Model:
    """Weights of classes (ROWS, CLASSES) and of words inside classes (ROWS, SLOTS)."""

    def __init__(self, counts: Counts):
        self.sizes = np.clip(counts.out - SLOTS * np.arange(OUT // SLOTS), 0, SLOTS)
        self.top = np.zeros((ROWS, CLASSES), np.float32)
        self.inner = np.zeros((ROWS, SLOTS), np.float32)
        mass = np.zeros(CLASSES)
        n = np.zeros(OUT)
        n[: counts.out] = counts.head_n[: counts.out]
        mass[: OUT // SLOTS] = n.reshape(-1, SLOTS).sum(1)
        mass[OUT // SLOTS :] = counts.rare_n
        self.prior_top = np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32)
        prior = np.log(n.reshape(-1, SLOTS) + 0.5)
        prior[np.arange(SLOTS) >= self.sizes[:, None]] = -np.inf
        self.prior_inner = prior.astype(np.float32)

    def class_odds(self, rows: np.ndarray) -> np.ndarray:
        """exp of the class scores, up to a factor a row."""
        z = np.repeat((self.prior_top + self.top[0])[None], rows.shape[1], axis=0)
        return _odds(z, self.top, rows)

    def word_odds(self, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """exp of the word scores inside the class, up to a factor a row."""
        return _odds(np.take(self.prior_inner + self.inner[CLASS_ROWS], cls, axis=0), self.inner, rows)

    def sums(self, head_end: np.ndarray) -> Sums:
        """What the word in front gives to the classes, and its ending to a class's words, summed once for every such
        word and ending instead of at every token; right until the next step."""
        end = np.r_[np.resize(head_end[:OUT], OUT) if len(head_end) else np.zeros(OUT, np.int64), np.arange(ENDS)]
        ident = np.arange(OUT + ENDS)
        after = self.prior_top + self.top[0] + self.top[hashed(1, ident)] + self.top[hashed(2, end)]
        cls, end = (x.ravel() for x in np.indices((OUT // SLOTS, ENDS)))
        inside = (self.prior_inner + self.inner[CLASS_ROWS])[cls] + self.inner[hashed(7, end, cls)]
        after, inside = (x - x.max(axis=1, keepdims=True) if x.size else x for x in (after, np.where(self.sizes[cls, None] > 0, inside, 0)))
        low = [-float(np.min(x, where=np.isfinite(x), initial=0)) + 3 * float(np.abs(t).max()) for x, t in ((after, self.top), (inside, self.inner))]
        if max(low) < SPAN:
            return Sums(*(np.exp(x, dtype=np.float32) for x in (after, inside, self.top, self.inner)), _times)
        return Sums(after, inside, self.top, self.inner, _odds)

    def log10(self, ev: dict[str, np.ndarray], sums: Sums | None = None) -> np.ndarray:
        """log10 P(class) and, for words with a slot, + log10 P(word | class), token by token."""
        out = np.empty(len(ev["cls"]))
        for i in range(0, len(out), CHUNK):
            at = slice(i, i + CHUNK)
            cls, top = ev["cls"][at], ev["top"][:, at]
            p = _share(sums.odds(np.take(sums.after, ev["before"][at], axis=0), sums.top, top[2:]) if sums else self.class_odds(top), cls)
            k = np.flatnonzero(ev["known"][at])
            if len(k):
                own, inner = cls[k], ev["inner"][:, at][:, k]
                odds = sums.odds(np.take(sums.inside, own * ENDS + ev["end"][at][k], axis=0), sums.inner, inner[1:]) if sums else self.word_odds(inner, own)
                p[k] *= _share(odds, ev["slot"][at][k])
            out[at] = np.log10(np.maximum(p, 1e-30))
        return out

    def step(self, ev: dict[str, np.ndarray], rng: np.random.Generator, seen: list[np.ndarray]) -> None:
        """One gradient step over some tokens; ``seen`` counts the moves of each weight, which shorten its steps."""
        cls = ev["cls"]
        u = rng.random((len(cls), 1), np.float32)
        self._move(self.top, seen[0], _drawn(u, self.class_odds(ev["top"])), ev["top"], cls, None)
        k = np.flatnonzero(ev["known"])
        if len(k):
            rows = ev["inner"][:, k]
            u = rng.random((len(k), 1), np.float32)
            self._move(self.inner, seen[1], _drawn(u, self.word_odds(rows, cls[k])), rows, ev["slot"][k], cls[k])

    @staticmethod
    def _move(table: np.ndarray, seen: np.ndarray, drawn: np.ndarray, rows: np.ndarray, there: np.ndarray, cls: np.ndarray | None) -> None:
        width = table.shape[1]
        differ = drawn != there
        bias = np.zeros(int(differ.sum()), np.int64) if cls is None else CLASS_ROWS[cls[differ]]
        base = np.vstack([bias[None], rows[:, differ]]) * width
        flat = table.reshape(-1)
        for sign, at in ((1.0, (base + there[differ]).ravel()), (-1.0, (base + drawn[differ]).ravel())):
            np.add.at(seen, at, np.float32(1))
            np.add.at(flat, at, (sign * RATE / np.sqrt(seen[at] + DAMP)).astype(np.float32))


CLASS_ROWS = hashed(6, np.arange(OUT // SLOTS))  # the rows of the classes' own weights


def _odds(z: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    part = np.empty_like(z)
    for r in rows:
        np.take(table, r, axis=0, out=part, mode="clip")
        z += part
    if not (z.max() < SAFE and z[:, 0].min() > -SAFE):
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _times(z: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """As ``_odds``, of odds instead of scores."""
    part = np.empty_like(z)
    for r in rows:
        np.take(table, r, axis=0, out=part, mode="clip")
        z *= part
    return z


def _reach(sums: np.ndarray, aim: np.ndarray) -> np.ndarray:
    """For every column the first row at which the sums are at least ``aim``, the last at most."""
    return np.add.reduce((sums[:-1] < aim).view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)


def _running(parts: np.ndarray) -> np.ndarray:
    """Parts, summed up over the rows in place."""
    for a, b in pairwise(parts):
        b += a
    return parts


def _drawn(u: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """One column a row, drawn by its odds with the uniform numbers ``u``: first a group of columns, then one of it."""
    n, width = odds.shape
    size = GROUP if width % GROUP == 0 else width
    k, groups = np.arange(n), width // size
    sums = np.zeros((groups + 1, n), np.float32)
    sums[1:] = (odds @ np.repeat(np.eye(groups, dtype=np.float32), size, axis=0)).T
    aim = u[:, 0] * _running(sums)[-1]
    group = _reach(sums[1:], aim)
    own = _running(np.take(odds.reshape(-1, size), k * groups + group, axis=0).T.copy())
    return group * size + _reach(own, np.minimum(aim - np.take(sums, group * n + k), own[-1]))


def _share(odds: np.ndarray, of: np.ndarray) -> np.ndarray:
    return odds[np.arange(len(of)), of].astype(float) / (odds @ np.ones(odds.shape[1], odds.dtype))


def _coded(texts: list[bytes | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    words, at, sizes = tokens(texts)
    return vocab.codes(words)[at], np.cumsum(sizes) - sizes, [words.to_numpy(zero_copy_only=False)[at]]


def _tails(words: list, starts: np.ndarray, tail: np.ndarray, vocab: Vocabulary) -> tuple[pa.Array, pa.Array]:
    """For every text the different keys of its words outside the head, and how often each stands there."""
    outside = np.concatenate([np.asarray(w, object) for w in words])[tail]
    keys = np.fromiter(map(vocab.tail.__getitem__, outside), np.int64, len(outside))
    text = np.searchsorted(starts, np.flatnonzero(tail), side="right") - 1
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])][: len(keys)])
    times = np.diff(np.r_[first, len(keys)])
    cuts = pa.array(np.searchsorted(text[first], np.arange(len(starts) + 1)), pa.int32())
    return pa.ListArray.from_arrays(cuts, pa.array(keys[first])), pa.ListArray.from_arrays(cuts, pa.array(times))


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts (of ``size`` bytes) make ``SLICE`` together, one at least."""
    size = np.cumsum(b.column("size").to_numpy())
    at = 0
    while at < b.num_rows:
        upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right"))
        upto = max(upto, at + 1)
        yield b.slice(at, upto - at)
        at = upto


def coded(docs: DataFrame, keys: Broadcast, rounds: int = ROUNDS) -> DataFrame:
    """(row, doc_id, part, size, codes, keys, times) of every row of ``docs`` (doc_id, text), written once for training and
    scoring: ``part`` is the round in which it teaches, by hash of the text, or -1; ``size`` its text's bytes; ``codes`` are its tokens' places in the
    head and endings (see ``Vocabulary``) as 4-byte integers; then come its keys outside the head and their numbers."""
    part = F.when(fold("doc_id", FOLDS) != HELD, F.pmod(F.xxhash64(F.lit("round"), "text"), F.lit(rounds)).cast("int")).otherwise(-1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, task, row = vocabulary(keys.value), TaskContext.get().partitionId(), 0
        for b in batches:
            for s in _slices(b):
                codes, starts, words = _coded(raw(s, "text"), vocab)
                n = s.num_rows
                cuts = np.r_[starts, len(codes)] * 4
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts), pa.py_buffer(codes.astype(np.int32))])
                cols = [
                    pa.array((np.arange(n) + row) | (task << 40), pa.int64()),
                    s.column("doc_id").cast(pa.int64()),
                    s.column("part"),
                    s.column("size"),
                    blob.cast(pa.binary()),
                    *_tails(words, starts, codes < 0, vocab),
                ]
                row += n
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "part", "size", "codes", "keys", "times"])

    rows = docs.select("doc_id", "text", part.alias("part"), _size())
    return settle(rows.mapInArrow(run, "row long, doc_id long, part int, size int, codes binary, keys array<long>, times array<long>"))


def _read(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of coded rows: the rows, the codes of all their tokens, the first token of each."""
    for s in _slices(b):
        blob = s.column("codes").cast(pa.large_binary())
        cuts = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
        codes = np.frombuffer(blob.buffers()[2], np.int32, int(cuts[-1] - cuts[0]) // 4, int(cuts[0]))
        yield s, codes.astype(np.int64), (cuts[:-1] - cuts[0]) // 4


def train(table: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """Weights after one pass over the documents that teach of a ``coded`` table, in the rounds that it gives them."""
    model = Model(counts)
    sc = table.sparkSession.sparkContext
    for r in range(rounds):
        start = sc.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = start.value
            m0 = (m.top.copy(), m.inner.copy())
            m.top, m.inner = m0[0].copy(), m0[1].copy()
            seen = [np.zeros(m.top.size, np.float32), np.zeros(m.inner.size, np.float32)]
            rng, done = np.random.default_rng([r, 11]), 0
            for b in batches:
                for _, codes, starts in _read(b):
                    ev = events(codes, starts)
                    for i in range(0, len(codes), CHUNK):
                        m.step({k: v[..., i : i + CHUNK] for k, v in ev.items()}, rng, seen)
                    done += len(codes)
            if done:
                both = np.concatenate([(a - b).ravel() for a, b in zip((m.top, m.inner), m0)]).astype(np.float16)
                cut = np.array_split(both, BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary()), pa.array([done] * BLOCKS, pa.int64())], names=["block", "w", "n"])
            m.top, m.inner = m0

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = there = 0.0
            for x, n in zip(pdf["w"], pdf["n"]):
                d = np.frombuffer(x, np.float16).astype(np.float64)
                total, there = total + d * n, there + (d != 0) * n
            w = total / np.maximum(there, 1)  # a mean over the tasks that moved the weight
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "w": [w.astype(np.float32).tobytes()]})

        moved = table.where(F.col("part") == r).select("size", "codes").mapInArrow(run, "block int, w binary, n long")
        got = moved.groupBy("block").applyInPandas(add, "block int, w binary").collect()  # BLOCKS rows, one model
        if got:
            both = np.concatenate([np.frombuffer(x.w, np.float32) for x in sorted(got, key=lambda x: x.block)])
            model.top = model.top + both[: model.top.size].reshape(model.top.shape)
            model.inner = model.inner + both[model.top.size :].reshape(model.inner.shape)
        start.destroy()
    return model


def scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` the model's. A NULL or blank text is one end
    token; a NULL doc_id is in no fold, so it neither is held out nor teaches; repeated rows are scored each; without
    training documents both scores rest on one unseen kind. Only doc_id and text are read.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    teach = docs.where(fold("doc_id", FOLDS) != HELD)
    table = settle(word_counts(teach))
    counts = Counts(table)
    t = coded(docs, sc.broadcast(counts.keys), rounds)
    model = train(t, counts, rounds)
    shipped = sc.broadcast((model, counts, model.sums(counts.head_end)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c, sums = shipped.value
        head_log = np.log10(c.head_n + 0.5) if len(c.head_n) else np.zeros(0)
        rare_all = np.log10(c.rare_n + 0.5 * (c.rare_v + 1))
        for b in batches:
            for s, codes, starts in _read(b):
                place, rare = codes >> 8, (codes & 255) % RARE
                ev = events(codes, starts)
                head = place >= 0
                own = np.zeros(len(codes))
                own[head] = head_log[place[head]]
                model_part = m.log10(ev, sums) + np.where(ev["known"], 0.0, np.where(head, own, 0.0) - rare_all[rare])
                cols = [
                    s.column("row"),
                    s.column("doc_id"),
                    pa.array(np.diff(np.r_[starts, len(codes)])),
                    pa.array(np.add.reduceat(head.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(own, starts)),
                    pa.array(np.add.reduceat(model_part, starts)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_tokens", "head_known", "head_log", "model_log"])

    scored = t.select("row", "doc_id", "size", "codes").mapInArrow(run, "row long, doc_id long, n_tokens long, head_known long, head_log double, model_log double")
    tail = t.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("k"))
    found = tail.join(table.select("key", "n"), "key", "left")
    c = F.coalesce("n", F.lit(0))
    per = found.groupBy("row").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("tail_known"), F.sum(F.col("k") * F.log10(c + 0.5)).alias("tail_log"))
    j = scored.join(per, "row", "left").fillna(0, ["tail_known"]).fillna(0.0, ["tail_log"])
    whole = float(np.log10(counts.n + 0.5 * (counts.kinds + 1)))
    return j.select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.col("tail_known")).alias("n_known"),
        F.lit(counts.n).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("tail_log") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("model_log") + F.col("tail_log")).alias("score"),
    )
