"""Exact token counts of every prefix by dynamic programming over prefixes.

Let the encoding of each shorter prefix be known by its last token. The last token t of a longer prefix is the one
suffix piece that is preceded by a prefix whose own last token p lets the pair (p, t) stand, that is, the text of both
is encoded as just these two. A sequence of pieces is what the merges give exactly when all its neighbours can stand
so; hence one last token and one count per prefix say all, and a prefix has one token more than the prefix before t.
Suffix pieces come from an Aho-Corasick automaton; pairs are asked of the library once and remembered. No piece crosses
a word start, so the table of a word serves all its occurrences, and a text's table is its words' tables, each raised
by the count in front of it.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.base import TOKENIZERS, over_batches
from tidemark.llm.pieces import MARK, MODEL, Pieces, load

CACHED = 1 << 18  # word tables and pairs held by a process; beyond that a cache starts anew
ALONE = -1  # last token of a prefix that ends in bytes, which join with nothing


class Words(dict):
    """Tables by word, made when first asked for. A full generation is put aside, and words still in use come back from it."""

    def __init__(self, make):
        self.make, self.aside = make, {}

    def __missing__(self, word: str) -> bytes:
        got = self.aside.get(word)
        if got is None:
            got = self.make(word)
        if len(self) >= CACHED:
            self.aside = dict(self)
            self.clear()
        self[word] = got
        return got


class PrefixCounts:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.pairs: dict[int, bool] = {}
        self.words = Words(self._table)
        self.found = ahocorasick.Automaton()
        for p, i in pieces.ids.items():
            self.found.add_word(p, (len(p), i))
        self.found.make_automaton()
        # a character without a piece keeps the library's own leading space away from a pair
        self.wall = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in pieces.ids)
        self.head = pieces.lib.encode(self.wall)
        self.shift = len(pieces.texts).bit_length()

    def _stands(self, key: int) -> bool:
        """Is the text of two pieces encoded as these two?"""
        if len(self.pairs) >= 4 * CACHED:
            self.pairs.clear()
        left, right = key >> self.shift, key & (1 << self.shift) - 1
        text = (self.pieces.texts[left] + self.pieces.texts[right]).replace(MARK, " ")
        got = self.pairs[key] = self.pieces.lib.encode(self.wall + text) == [*self.head, left, right]
        return got

    def _table(self, rest: str) -> bytes:
        """Counts of all prefixes, from length 1, of a surface part given without its first mark; packed int32."""
        word = MARK + rest
        n, shift, known = len(word), self.shift, self.pairs.get
        last, count = [ALONE] * (n + 1), [0] * (n + 1)
        done = 0
        for end, (size, piece) in self.found.iter(word):
            if end < done:
                continue  # this prefix has its last token
            if end > done:
                self._as_bytes(word, done, end, last, count)
                done = end
            j = end + 1 - size
            left = last[j]
            if left >= 0:
                key = left << shift | piece
                stands = known(key)
                if not (self._stands(key) if stands is None else stands):
                    continue
            done = end + 1
            last[done], count[done] = piece, count[j] + 1
        if done < n:
            self._as_bytes(word, done, n, last, count)
        return array('i', count[1:]).tobytes()

    @staticmethod
    def _as_bytes(word: str, done: int, until: int, last: list[int], count: list[int]) -> None:
        """Characters that no piece holds: one token a byte."""
        for k in range(done, until):
            last[k + 1], count[k + 1] = ALONE, count[k] + len(word[k].encode("utf-8"))

    def prefixes(self, text: str) -> np.ndarray:
        """``out[k]``: tokens of the first k characters of the text, k from 0."""
        if not text:
            return np.zeros(1, np.int32)
        words = text.split(" ")
        if "" in words or MARK in text:  # runs of spaces, or marks of its own
            words = [p[1:] for p in self.pieces.parts(text)]
        tables = list(map(self.words.__getitem__, words))
        sizes = np.fromiter(map(len, tables), np.int64, len(tables)) >> 2
        flat = np.frombuffer(b"".join(tables), np.int32)
        before = np.r_[0, np.cumsum(flat[np.cumsum(sizes) - 1])[:-1]]
        flat = flat + np.repeat(before, sizes).astype(np.int32)
        flat[0] = 0  # the space in front of an empty text is no token
        return flat


@lru_cache(maxsize=4)
def counter(model: str, folder: str) -> PrefixCounts:
    """One per Python process, so that later tasks find the words of earlier ones."""
    return PrefixCounts(load(model, folder))


def longest_within(prefix: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix <= budget)[-1])


def prefix_counts(docs: DataFrame, model: str = MODEL, folder: str | None = TOKENIZERS) -> DataFrame:
    """(doc_id, prefix_tokens array<int>): tokens of every prefix of the whole text, from the empty one.

    A NULL text counts as empty: [0]. Rows are independent, so repeated rows and empty tables need nothing special;
    other columns are not read.
    """

    def start():
        p = counter(model, folder)
        return lambda b: {"doc_id": b.column("doc_id"), "prefix_tokens": [p.prefixes(t or "") for t in b.column("text").to_pylist()]}

    return over_batches(docs.select("doc_id", "text"), "doc_id long, prefix_tokens array<int>", None, start)


def token_counts(docs: DataFrame, limit: int, model: str = MODEL, folder: str | None = TOKENIZERS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fits_chars): the answers that one table per text gives.

    ``fits_chars`` is the length of the longest prefix of at most ``limit`` tokens.
    """

    def start():
        p = counter(model, folder)

        def run(b: pa.RecordBatch) -> dict:
            texts = [t or "" for t in b.column("text").to_pylist()]
            tables = [p.prefixes(t) for t in texts]
            n = [int(t[-1]) for t in tables]
            return {
                "doc_id": b.column("doc_id"),
                "n_bytes": [len(t.encode("utf-8")) for t in texts],
                "n_tokens": n,
                "over_limit": [k > limit for k in n],
                "fits_chars": [len(x) if k <= limit else longest_within(t, limit) for x, k, t in zip(texts, n, tables)],
            }

        return run

    return over_batches(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long", None, start)
