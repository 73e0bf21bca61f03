"""N best segmentations into pieces: a forward Viterbi pass gives the exact distance to the start of every position of
the piece lattice, and an A* search backward from the end uses it as its heuristic, so paths come out best first.

No piece crosses a word start, so the lattice of a text is a chain of word lattices. A word's n best paths are searched
once and kept; the n best of the text are the n best ways to swap single words' paths for worse ones, and only the n
words with the smallest first loss can take part.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice
from math import inf
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.base import TOKENIZERS, over_batches
from tidemark.llm.pieces import MARK, MODEL, Pieces, load

N_BEST = 4
CACHED = 1 << 18  # words with their best paths in a generation of a process's cache
OTHERS = "array<array<struct<at:int,drop:int,ids:array<int>>>>"
UNSEEN = 10.0  # what a character without a piece costs beyond the worst piece


Swap = tuple[int, int, tuple[int, ...]]  # (at, drop, ids): ids in place of ``drop`` of the best ones from ``at`` on


class Lattice:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        worst = min((s for s in pieces.scores.values() if s > -1e6), default=0.0)
        # pieces that the file marks as unusable by score count as the worst ones
        self.scores = {p: max(s, worst) for p, s in pieces.scores.items()}
        self.unseen = worst - UNSEEN
        self.single = {p for p in pieces.ids if len(p) == 1}
        self.found = ahocorasick.Automaton()
        for p, i in pieces.ids.items():
            self.found.add_word(p, (len(p), self.scores[p], i))
            if not self.single.issuperset(p):
                raise ValueError("a piece holds a character that is no piece; words cannot be cut at such characters")
        self.found.make_automaton()
        self.words = _Words(self)

    def bytes_of(self, c: str) -> tuple[int, ...]:
        return tuple(self.pieces.byte_ids[x] for x in c.encode("utf-8", "surrogatepass"))

    def edges(self, word: str) -> tuple[list[list[tuple]], list[float]]:
        """For every end position its edges (score from the start, start, score, id or byte ids), and the best score."""
        n = len(word)
        best = [0.0] + [-inf] * n
        out: list[list] = [[] for _ in range(n + 1)]
        if self.single.issuperset(word):
            for end, (size, score, piece) in self.found.iter(word):
                at = end + 1 - size
                full = best[at] + score
                out[end + 1].append((full, at, score, piece))
                if full > best[end + 1]:
                    best[end + 1] = full
            return out, best
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, (size, score, piece) in self.found.iter(word):
            ends[end + 1].append((end + 1 - size, score, piece))
        for end in range(1, n + 1):
            c = word[end - 1]
            if c not in self.single:  # a character without a piece goes as its bytes
                ends[end].append((end - 1, self.unseen, self.bytes_of(c)))
            out[end] = [(best[at] + score, at, score, piece) for at, score, piece in ends[end]]
            best[end] = max(e[0] for e in out[end])
        return out, best

    def paths(self, word: str) -> Iterator[tuple[float, tuple[int, ...]]]:
        """All segmentations of a word, best score first.

        A search state is the part of a path from some position to the end. Its estimate, the score of that part plus
        the best score up to the position, is exact, so the best state is followed down its best edges at once; at
        every position on the way only the next best edge has to wait in the queue.
        """
        edges, _ = self.edges(word)
        queue: list = []
        made, at, tail, done, k = 0, len(word), None, 0.0, 0
        ranked: dict[int, list] = {}
        while True:
            while at:
                here = ranked.get(at)
                if here is None:
                    here = ranked[at] = sorted(edges[at], key=_by_score)
                full, start, score, piece = here[k]
                if k + 1 < len(here):
                    made += 1
                    heapq.heappush(queue, (-(here[k + 1][0] + done), at, made, tail, done, k + 1))
                tail, done, at, k = (piece, tail), done + score, start, 0
            ids: list[int] = []
            while tail:
                piece, tail = tail
                if type(piece) is int:
                    ids.append(piece)
                else:
                    ids += piece
            yield done, tuple(ids)
            if not queue:
                return
            _, at, _, tail, done, k = heapq.heappop(queue)

    def word(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        return list(islice(self.paths(word), n))

    def two(self, word: str) -> tuple[float, float, list[int], bool]:
        """The first step of the search alone: best score, what the second best path loses, best ids, and whether these
        read back as the word.

        The second best path leaves the best one at the position whose next best edge has the best estimate, and
        follows best edges from there. So two edges a position are enough, and no queue is needed.
        """
        size = len(word)
        # by the last character of an edge; [-1] is the start of the word
        best, second = [-inf] * size + [0.0], [-inf] * size
        edge: list = [None] * size
        other = edge.copy()
        bare = [] if self.single.issuperset(word) else [i for i, c in enumerate(word) if c not in self.single]
        at = 0
        for stop in [*bare, size]:
            for end, e in self.found.iter(word, at, stop) if at < stop else ():
                full = best[end - e[0]] + e[1]
                if full > best[end]:  # longer pieces come first, so an equal score keeps the smaller start
                    second[end], other[end] = best[end], edge[end]
                    best[end], edge[end] = full, e
                elif full > second[end]:
                    second[end], other[end] = full, e
            at = stop + 1
            if stop < size:  # no piece crosses a character without one
                best[stop], edge[stop] = best[stop - 1] + self.unseen, (1, self.unseen, self.bytes_of(word[stop]))
        ids: list = []
        done, top, leave, tail = 0.0, -inf, -1, 0.0
        at = size - 1
        while at >= 0:
            if second[at] > -inf and second[at] + done >= top:
                top, leave, tail = second[at] + done, at, done
            size, score, piece = edge[at]
            ids.append(piece)
            done += score
            at -= size
        ids.reverse()
        loss = inf
        if leave >= 0:
            size, score, _ = other[leave]
            while leave >= 0:
                tail += score
                leave -= size
                if leave >= 0:
                    size, score, _ = edge[leave]
            loss = done - tail
        if bare:
            ids = [i for x in ids for i in (x if type(x) is tuple else (x,))]
            return done, loss, ids, surface_of(self.pieces, ids) == word
        return done, loss, ids, "".join(map(self.pieces.texts.__getitem__, ids)) == word

    def best(self, text: str, n: int) -> tuple[list[float], list[bytes], bool, list[list[Swap]]]:
        """Scores and packed ids of the n best segmentations of a whole text, fewer if there are fewer; whether
        they all read back as the text; and what each of those after the best one has in place of its ids."""
        parts = self.pieces.parts(text)
        if not parts:
            return [0.0], [b""], not text, []
        words = list(map(self.words.__getitem__, parts))
        gaps = map(itemgetter(1), words)
        packed = list(map(itemgetter(2), words))
        first = sum(map(itemgetter(0), words))
        open_ = smallest(np.fromiter(gaps, np.float64, len(words)), n - 1)
        options = [self.word(parts[i], n) for i in open_]
        reads = all(map(itemgetter(3), words)) and sum(map(len, parts)) == len(text) + 1
        top = b"".join(packed)
        ends = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)))
        scores, out, swaps = [first], [top], []
        for loss, picks in best_swaps(options, n)[1:]:
            own, kept, here = [], 0, []
            for k, r in sorted(picks.items(), key=lambda x: open_[x[0]]):
                ids, end = options[k][r][1], int(ends[open_[k]])
                at = end - len(packed[open_[k]])
                own += top[kept:at], array("i", ids).tobytes()
                kept = end
                here.append((at // 4, (end - at) // 4, ids))
                reads = reads and surface_of(self.pieces, ids) == parts[open_[k]]
            scores.append(first - loss)
            out.append(b"".join([*own, top[kept:]]))
            swaps.append(here)
        return scores, out, reads, swaps

    def text(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text as (score, ids)."""
        scores, packed, _, _ = self.best(text, n)
        return [(s, np.frombuffer(p, np.int32).tolist()) for s, p in zip(scores, packed)]


class _Words(dict):
    """word: (best score, what the second best path loses, packed ids, whether they read back as the word)."""

    def __init__(self, lattice: Lattice):
        self.lattice, self.aside = lattice, {}

    def __missing__(self, word: str) -> tuple:
        got = self.aside.get(word)
        if got is None:
            score, loss, ids, reads = self.lattice.two(word)
            got = (score, loss, array("i", ids).tobytes(), reads)
        if len(self) >= CACHED:
            self.aside = dict(self)
            self.clear()
        self[word] = got
        return got


def _by_score(edge: tuple) -> tuple:
    return -edge[0], edge[1]


def smallest(gaps: np.ndarray, k: int) -> list[int]:
    """Places of the k smallest finite gaps, ties by place."""
    if k < 1:
        return []
    if k < len(gaps):
        near = np.flatnonzero(gaps <= np.partition(gaps, k - 1)[k - 1])
    else:
        near = np.arange(len(gaps))
    near = near[np.argsort(gaps[near], kind="stable")][:k]
    return near[gaps[near] < inf].tolist()


def best_swaps(options: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n smallest total losses over choices of one path per word, with the words that leave their best path."""
    found: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    for k, paths in enumerate(options):
        grown = [(loss + paths[0][0] - p[0], picks + (((k, r),) if r else ())) for loss, picks in found for r, p in enumerate(paths)]
        found = sorted(grown, key=lambda x: (x[0], len(x[1]), x[1]))[:n]
    return [(loss, dict(picks)) for loss, picks in found]


def surface_of(pieces: Pieces, ids: Sequence[int]) -> str:
    """Text of piece ids, with marks for spaces; runs of byte pieces are read as UTF-8."""
    first = pieces.byte_ids[0]
    if not any(first <= i < first + 256 for i in ids):
        return "".join(map(pieces.texts.__getitem__, ids))
    out = bytearray()
    for i in ids:
        out += bytes([i - first]) if first <= i < first + 256 else pieces.texts[i].encode("utf-8")
    return out.decode("utf-8", "surrogatepass")


def decode(pieces: Pieces, ids: Sequence[int]) -> str:
    """The text of a segmentation: marks as spaces, the one in front dropped."""
    return surface_of(pieces, ids).replace(MARK, " ")[1:]


def digest(packed: bytes) -> int:
    """63-bit XXH64 of the ids as little-endian 32-bit numbers."""
    return xxhash.xxh64_intdigest(packed) >> 1


@lru_cache(maxsize=4)
def lattice(model: str, folder: str) -> Lattice:
    return Lattice(load(model, folder))


def segmentations(docs: DataFrame, n: int = N_BEST, model: str = MODEL, folder: str | None = TOKENIZERS) -> DataFrame:
    """(doc_id, rank, score, ids array<int>): the n best segmentations of each whole text, best first.

    A NULL text counts as empty and has one segmentation, without pieces; equal scores keep the order of the search;
    repeated rows are independent; an empty table gives none. Only doc_id and text are read.
    """

    def start():
        lat = lattice(model, folder)

        def run(b: pa.RecordBatch) -> dict:
            rows = [(d, r + 1, s, ids) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for r, (s, ids) in enumerate(lat.text(t or "", n))]
            return dict(zip(("doc_id", "rank", "score", "ids"), map(list, zip(*rows))))

        return run

    return over_batches(docs.select("doc_id", "text"), "doc_id long, rank int, score double, ids array<int>", None, start)


def encoded(docs: DataFrame, n: int = N_BEST, model: str = MODEL, folder: str | None = TOKENIZERS, keep: list[str] = ()) -> DataFrame:
    """(doc_id, n_paths, ids array<int>, others array<array<struct<at, drop, ids>>>, scores array<double>,
    digests array<long>, round_trip): the n best segmentations of each text. ``ids`` is the best one; each of ``others``,
    in order, is the best one with ``drop`` ids from place ``at`` on (the first is 0) replaced by others, once or more
    from left to right, at most n - 1 times. ``path`` spells one out. ``scores`` and ``digests`` (of the whole ids) are
    those of all paths; ``round_trip``: every one reads back as the text (a mark in the text is read as the space it
    stands for).

    Columns named in ``keep`` come along as ``__keep_0`` and so on, whatever their names.
    """

    def start():
        lat = lattice(model, folder)

        def run(b: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("n_paths", "ids", "others", "scores", "digests", "round_trip")}
            for t in b.column("text").to_pylist():
                scores, packed, reads, swaps = lat.best(t or "", n)
                out["n_paths"].append(len(scores))
                out["ids"].append(np.frombuffer(packed[0], np.int32))
                out["others"].append(swaps)
                out["scores"].append(scores)
                out["digests"].append([digest(p) for p in packed])
                out["round_trip"].append(reads)
            return {"doc_id": b.column("doc_id"), **out, **{f"__keep_{i}": b.column(f"__keep_{i}") for i in range(len(keep))}}

        return run

    carried = [F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)]
    types = "".join(f", __keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    schema = f"doc_id long, n_paths int, ids array<int>, others {OTHERS}, scores array<double>, digests array<long>, round_trip boolean" + types
    return over_batches(docs.select("doc_id", "text", *carried), schema, None, start)


def path(rank: int, ids: str | Column = "ids", others: str | Column = "others") -> Column:
    """The ids of the segmentation of that rank (the best is 1) from two columns of ``encoded``; NULL if there is none."""
    ids, others = (F.col(c) if isinstance(c, str) else c for c in (ids, others))
    if rank == 1:
        return ids
    swaps, end = F.get(others, rank - 2), F.size(ids)
    none = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("kept"))

    def swap(done: Column, s: Column) -> Column:
        part = F.slice(ids, done["kept"] + 1, s["at"] - done["kept"])
        return F.struct(F.concat(done["ids"], part, s["ids"]).alias("ids"), (s["at"] + s["drop"]).alias("kept"))

    return F.aggregate(swaps, none, swap, lambda done: F.concat(done["ids"], F.slice(ids, done["kept"] + 1, end - done["kept"])))


def with_pieces(docs: DataFrame, n: int = N_BEST, **where) -> DataFrame:
    """``docs`` with piece_ids (the best segmentation), piece_scores (of the n best) and round_trip."""
    cols = docs.columns
    e = encoded(docs, n, keep=cols, **where)
    own = {"piece_ids": F.col("ids"), "piece_scores": F.col("scores"), "round_trip": F.col("round_trip")}
    return e.select(*(F.col(f"__keep_{i}").alias(c) for i, c in enumerate(cols) if c not in own), *(v.alias(k) for k, v in own.items()))
