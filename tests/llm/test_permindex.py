import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import permindex as P


def exact(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    u = {j: v / np.linalg.norm(v) for j, (_, v) in enumerate(good)}
    out = {}
    for j, (q, _) in enumerate(good):
        if q % every == 0:
            c = sorted((-round(float(u[j] @ u[m]), 12), i) for m, (i, _) in enumerate(good) if i != q)
            out[q] = [(i, -s) for s, i in c[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    return got


def test_exact_when_all_is_reranked(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)] + [(200 + i, [1.0] * 8) for i in range(12)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0] * 7 + [None]), (304, [float("inf")] * 8), (None, [1.0] * 8), (350, [1.0, 2.0])]
    got = found(P.search(frame(spark, rows), every=10, shard=50, block=5))
    want = exact([r for r in rows if r[1] is None or len(r[1]) == 8], 10, 5)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [v for v, _ in near] == [v for v, _, _ in got[q]] and [k for _, _, k in got[q]] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, s in near], [s for _, s, _ in got[q]], atol=1e-9)
    assert [v for v, _, _ in got[200]] == [201, 202, 203, 204, 205] and [v for v, _, _ in got[210]] == [200, 201, 202, 203, 204]


def test_gains_are_footrule_distances():
    rng = np.random.default_rng(3)
    m, k = 12, 5
    lists = np.array([rng.permutation(m)[:k] for _ in range(40)], np.int16)
    s = P.Shard(lists, m)
    place = lambda x, p: list(x).index(p) if p in x else k
    for q in lists[:10]:
        foot = [sum(abs(place(q, p) - place(x, p)) for p in range(m)) for x in lists]
        gain = s.gains(q)
        assert len({int(f + g) for f, g in zip(foot, gain)}) == 1  # distance plus gain is a constant


@pytest.mark.parametrize("few", [0, 1, 3])
def test_few_rows(spark, few):
    rows = [(i * 50, [1.0, float(i)]) for i in range(few)]
    got = found(P.search(frame(spark, rows)))
    assert all(len(v) == few - 1 for v in got.values()) and len(got) == (few if few > 1 else 0)


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = found(P.search(df)), exact(rows, 50, 5)
    hit = sum(len({v for v, _ in want[q]} & {v for v, _, _ in got[q]}) for q in want)
    assert hit / (5 * len(want)) >= 0.95
