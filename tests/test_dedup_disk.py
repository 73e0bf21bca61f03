"""What near-duplicate removal keeps on disk, and that its bounds lose no pair."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import session as S
from tidemark.operators import dedup as D


def texts(n=150, words=80):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        t = list(rng.choice([f"w{k}" for k in range(words)], rng.integers(3, 30)))
        out.append(" ".join(t if i % 4 or not i else out[rng.integers(0, i)].split() + t[: rng.integers(0, 2)]))
    return out


def test_only_the_result_stays_on_disk(spark):
    d = spark.createDataFrame(list(enumerate(texts(60))), "i long, text string")
    at, was = S.mark(), spark.conf.get(S.TIDY)
    got = D.drop_near_duplicates(d, "i", "text", 0.85, [], 1, 16)
    written = [p.removeprefix("file:") for p in S.written_since(at)]
    assert len(written) > 10 and sum(map(os.path.exists, written)) == 1
    assert 0 < got.count() < 60 and spark.conf.get(S.TIDY) == was


def test_a_null_text_stays(spark):
    d = spark.createDataFrame([(0, "one two three"), (1, None), (2, "one two three"), (3, None)], "i long, text string")
    assert sorted(r.i for r in D.drop_near_duplicates(d, "i", "text", 0.85, []).collect()) == [0, 1, 3]


@pytest.mark.parametrize(("block", "meetings"), [(8192, 1 << 18), (1, 64)])
def test_bounds_lose_no_pair(spark, monkeypatch, block, meetings):
    """Pairs found from rare-first lists, in one cell or many, against all cosines; vectors move as one row of arrays."""
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "MEETINGS", meetings)
    monkeypatch.setattr(D, "ROWS", 16)
    t = texts()
    docs = S.settle(D.coded(spark.createDataFrame(list(enumerate(t)), "i long, text string"), "i", "text", []))
    vec = S.settle(D.vectors(docs, len(t), D.REST * 0.85))
    assert vec.count() == len(t) == vec.select("ord").distinct().count()
    lists = vec.select("ord", "s", F.slice("terms", 1, F.size("ws")).alias("terms"), "ws")
    cands = D.candidates(lists, lists, 0.85)
    got = {(r.lo, r.hi) for r in D.verified(cands, vec, len(t), 0.85).collect()}
    words = sorted({w for x in t for w in x.split()})
    tf = np.array([[x.split().count(w) for w in words] for x in t], float)
    w = tf * (np.log((1 + len(t)) / (1 + (tf > 0).sum(0))) + 1)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    lo, hi = np.nonzero(np.triu(w @ w.T >= 0.85 - 1e-12, 1))
    assert got == set(zip(lo.tolist(), hi.tolist())) and len(got) > 20
    assert cands.distinct().count() == cands.count() < len(t) * (len(t) - 1) / 4
