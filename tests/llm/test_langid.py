import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid as L

SYL = {"aa": ["the", "ing", "tion", "er"], "bb": ["ung", "sch", "keit", "ß"], "cc": ["ción", "ñ", "mente", "os"]}


def text(rnd, lang, n=40):
    return " ".join("".join(rnd.choice(SYL[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    rnd = random.Random(1)
    return [(i, text(rnd, k), k) for i in range(n) for k in [rnd.choice(["aa", "aa", "bb", "cc"])]]


def test_features_against_plain_counts():
    for t in ["", None, "a", "Ab\tñ x" * 3, "é" * 5000]:
        i, n = L.features(t)
        s = len((t or ""))
        assert n.sum() == sum(max(0, s - k + 1) for k in L.GRAMS) and len(set(i)) == len(i)
    a, b = L.features("AB\n"), L.features("ab ")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_one_ftrl_step_is_the_formula():
    idf = np.ones(1 << L.BITS)
    z, n = np.zeros((1 << L.BITS, 2)), np.zeros((1 << L.BITS, 2))
    L.ftrl_pass([("abc", 1)], idf, z, n)
    i, v = L.weighted("abc", idf)
    g = v[:, None] * np.array([0.5, -0.5])
    assert np.allclose(z[i], g) and np.allclose(n[i], g * g) and np.count_nonzero(n) == 2 * len(i)
    assert (L.proximal(np.array([L.L1 / 2]), np.array([1.0])) == 0).all()


def test_held_out_accuracy_and_folds(spark, make_docs):
    rows = corpus() + [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", None), (1003, text(random.Random(3), "bb", 20000), None), (None, "the tion", "cc")]
    docs = make_docs(rows, {"lang_pred": F.lit(1), "score": F.lit("x")})
    got = {r.doc_id: r for r in L.languages(docs).collect()}
    for d, t, k in corpus():
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= got[d].score <= 1
    right = [got[d].lang_pred == k for d, t, k in corpus() if got[d].held_out]
    assert sum(right) / len(right) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"] and not got[None].held_out


def test_the_held_out_fold_teaches_nothing(spark, make_docs):
    rows = corpus(120)
    twisted = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 3 == 1 else k) for d, t, k in rows]
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.languages(make_docs(rows)).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in L.languages(make_docs(twisted).repartition(3)).collect()}
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()} and all(abs(a[k][1] - b[k][1]) < 1e-9 for k in a)


def test_nothing_to_learn_from(spark, make_docs):
    docs = make_docs([(2, "abc", None), (3, "def", None)])
    assert [(r.lang_pred, r.score) for r in L.languages(docs).collect()] == [("und", 0.0)] * 2
    assert L.languages(docs.limit(0)).count() == 0
