import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidemark.llm import permuterm


def plain(docs, min_length=5, min_count=3):
    """The contract in plain Python over (doc_id, text): word -> (form, root, n, n_near, form_n)."""
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    return spelled(n)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(n):
    by_len = {}
    for w in n:
        by_len.setdefault(len(w), []).append(w)
    forms, out = {}, {}
    for w in n:
        got = [x for k in (-1, 0, 1) for x in by_len.get(len(w) + k, []) if near(w, x)]
        best = min(got, key=lambda x: (-n[x], x), default=None)
        ok = best is not None and n[best] >= 2 * n[w]
        forms[w] = best if ok else None
        out[w] = (len(got), n[best] if ok else None)
    result = {}
    for w in n:
        r = w
        while forms[r]:
            r = forms[r]
        result[w] = (forms[w], r, n[w], *out[w])
    return result


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.where("doc_id % 4 = 0")
    want = plain([(r.doc_id, r.text) for r in some.collect()])
    got = permuterm.variants(some)
    assert rows(got) == want and got.count() == len(want) > 200
    assert sum(v[0] is not None for v in want.values()) > 5


VOCABULARIES = [
    {"aaaaa": 9, "aaaa": 3, "aaaaaa": 4, "aabaa": 20, "aaaab": 20},
    {"hello": 40, "hallo": 20, "hullo": 10, "hallos": 5, "halos": 4, "jello": 40},
    {"café0": 7, "cafés": 3, "cafes": 3, "ÿafés": 100, "afés": 6},
    {f"word{c}": i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")},
    {"lonely": 5},
]


@pytest.mark.parametrize("n", VOCABULARIES)
def test_vocabularies(spark, n):
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = spelled(n)
    got = {r.word: (r.n_near, None if r.best is None else (r.best.word, -r.best.minus)) for r in permuterm.linked(words).collect()}
    pairs = Counter((r.word, r.near) for r in permuterm.neighbours(words).collect())
    assert set(pairs) == {(a, b) for a in n for b in n if a != b and near(a, b)} and set(pairs.values()) <= {1}
    for w, (k, best) in got.items():
        assert k == want[w][3] == sum(a == w for a, _ in pairs)
        assert (best and best[0]) == min((b for a, b in pairs if a == w), key=lambda x: (-n[x], x), default=None)


def test_long_chain_of_forms(spark, make_docs):
    words = ["ABCDEFGH"[:k] * 1 + "z" * (9 - k) for k in range(8)]  # each one replacement from the next
    docs = make_docs([(i, " ".join(w for k, w in enumerate(words) for _ in range(3 * 2**k))) for i in range(1, 2)])
    got = rows(permuterm.variants(docs))
    assert got == plain([(1, r.text) for r in docs.collect()]) and len(got) == 8
    last = words[-1].lower()
    assert {v[1] for v in got.values()} == {last} and got[last][0] is None
    assert permuterm.groups(permuterm.variants(docs)).collect()[0] == (last, 8, sum(3 * 2**k for k in range(8)))


def test_odd_rows(spark, make_docs):
    texts = [(1, None), (2, ""), (None, "Ärger ärger ÄRGER ärgen ärgen ärgen"), (3, "x" * 3000 + " " + "x" * 2999 + "y"), (3, "x" * 3000 + " " + "x" * 2999 + "y")] * 3
    docs = make_docs(texts, {"word": F.lit("w"), "n": F.lit(1), "run": F.lit(2)})
    assert rows(permuterm.variants(docs)) == plain(texts)
    assert permuterm.variants(docs.limit(0)).collect() == []
