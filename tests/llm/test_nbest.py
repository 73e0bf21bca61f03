import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import nbest as N
from tidemark.llm.pieces import load


@pytest.fixture(scope="module")
def lat():
    return N.Lattice(load())


def every(lat, part):
    """All segmentations of a surface string by recursion."""
    if not part:
        return [(0.0, ())]
    out = []
    for k in range(1, len(part) + 1):
        if part[:k] in lat.pieces.ids:
            out += [(lat.scores[part[:k]] + s, (lat.pieces.ids[part[:k]], *r)) for s, r in every(lat, part[k:])]
    if part[0] not in lat.pieces.ids:
        raw = tuple(lat.pieces.byte_ids[b] for b in part[0].encode())
        out += [(lat.unseen + s, (*raw, *r)) for s, r in every(lat, part[1:])]
    return out


@pytest.mark.parametrize("text", ["the", " of", "ab cd", "the it", "a\nb", "é日", "  ", "x", "in a on"])
def test_against_all_segmentations(lat, text):
    want = sorted(every(lat, lat.pieces.surface(text)), key=lambda x: -x[0])
    for n in (1, 3, 7):
        got = lat.text(text, n)
        assert len(got) == min(n, len(want)) and len({tuple(i) for _, i in got}) == len(got)
        assert all(math.isclose(g[0], w[0], rel_tol=1e-12) for g, w in zip(got, want))
        by = dict((ids, s) for s, ids in want)
        assert all(math.isclose(by[tuple(ids)], s, rel_tol=1e-12) for s, ids in got)
        assert all(N.decode(lat.pieces, ids) == text for _, ids in got)


def test_paths_come_in_order_and_all(lat):
    want = every(lat, "▁tion.")
    got = list(lat.paths("▁tion."))
    assert len(got) == len(want) and {i for _, i in got} == {i for _, i in want}
    assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def test_swaps_against_all_choices():
    rnd = random.Random(2)
    for _ in range(50):
        opts = [sorted(((-rnd.random(), ()) for _ in range(rnd.randint(2, 4))), reverse=True) for _ in range(rnd.randint(0, 4))]
        full = [0.0]
        for o in opts:
            full = [x + o[0][0] - p[0] for x in full for p in o]
        got = [x for x, _ in N.best_swaps(opts, 5)]
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, sorted(full)[:5])) and len(got) == min(5, len(full))


def test_documents_round_trip(spark, sf, make_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = N.encoded(docs).collect()
    assert len(out) == docs.count() and all(r.round_trip and r.scores == sorted(r.scores, reverse=True) and len(set(r.digests)) == r.n_paths for r in out)
    odd = make_docs([None, "", " ", "▁ x", "z" * 3000, ("tion and " * 20000), ("tion and " * 20000)], {"ids": F.lit(1), "rank": F.lit("x")})
    got = {r.doc_id: r for r in N.encoded(odd).collect()}
    assert all(r.round_trip for r in got.values()) and got[0].ids == [] == got[1].ids and got[5].ids == got[6].ids
    ranks = N.segmentations(odd.where("doc_id < 5")).groupBy("doc_id").agg(F.max("rank").alias("k")).collect()
    assert {r.doc_id: r.k for r in ranks}[0] == 1 and N.segmentations(odd.limit(0)).count() == 0


def test_first_step_equals_the_search(lat):
    rnd = random.Random(5)
    for _ in range(3000):
        word = "▁" * rnd.randint(1, 3) + "".join(rnd.choice("aeinorst.,\n\t1é日😀") for _ in range(rnd.randint(0, 9)))
        paths = lat.word(word, 2)
        score, loss, ids, reads = lat.two(word)
        assert (score, tuple(ids), reads) == (*paths[0], True)
        assert loss == (paths[0][0] - paths[1][0] if len(paths) > 1 else math.inf)


def test_smallest_gaps_by_value_then_place():
    rnd = random.Random(3)
    for _ in range(200):
        gaps = [rnd.choice([0.0, 0.5, 1.0, math.inf]) for _ in range(rnd.randint(0, 9))]
        for k in (0, 1, 3):
            want = [i for i in sorted(range(len(gaps)), key=gaps.__getitem__)[:k] if gaps[i] < math.inf]
            assert N.smallest(N.np.array(gaps), k) == want


def test_the_query_returns_the_ids_of_all_paths(spark, make_docs, lat, tmp_path):
    from tidemark.llm import queries

    texts = [None, "", "x", "the it", "ab cd é日", "in a on\n", "tion and " * 300, "a b c d e f g of the in on"]
    make_docs(texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.select("*", F.array_compact(F.array(*(N.path(k + 1) for k in range(N.N_BEST)))).alias("paths")).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        r, want = got[d], lat.text(t or "", N.N_BEST)
        assert r.paths == [ids for _, ids in want] and r.scores == [s for s, _ in want] and r.n_paths == len(want)
        assert r.digests == [N.digest(N.array("i", ids).tobytes()) for _, ids in want]
