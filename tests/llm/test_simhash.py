import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import graph, simhash as S


def plain(text):
    """The contract, one bit and one shingle at a time."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in words).split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    """Smallest id reachable over Hamming distance 4."""
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 4 and comp[j] < comp[i]:
                    comp[i] = comp[j]
                    changed = True
    return comp


def groups(df):
    return {r.doc_id: (r.bits & (1 << 64) - 1, r.component_id) for r in S.near_groups(df).collect()}


TEXTS = ["", None, " \n\t", "One two THREE", "one two three", "a b c d e f g", "A b\tc  d e f g", "é\xa0x É y z w", "word " * 30000, "x y z w v"]


def test_fingerprint_is_the_contract(spark, make_docs):
    got = groups(make_docs(TEXTS))
    assert [got[i][0] for i in range(len(TEXTS))] == [plain(t) for t in TEXTS]
    assert got[1][1] == got[2][1] == got[0][1] == 0 and got[4][1] == 3 and got[6][1] == 5


def test_spark_hash_agrees(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (1 << 64) - 1 == int(S.shingle_hashes(b"a b c d")[0])


@pytest.mark.parametrize("segments", [2, 3, 5])
def test_groups_against_all_pairs(spark, segments):
    rnd = random.Random(segments)
    fps = {}
    for i in range(0, 400, 10):
        x = rnd.getrandbits(64)
        for j in range(10):  # chains and stars of small steps, and far neighbours
            fps[i + j] = x
            for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 4, 5])):
                x ^= 1 << b
    dense = rnd.getrandbits(64)
    for k in range(120):  # one group that is longer than a short bucket
        fps[1000 + k] = dense ^ (1 << k % 64) ^ (1 << (k * 7) % 64)
    by = {}
    for i, f in fps.items():
        by.setdefault(f, i)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for f, i in by.items()], "bits long, rep long")
    pairs = S.links(df, 4, segments)
    n = pairs.count()
    got = {r.node: r.component for r in graph.components(pairs).collect()}
    want = brute({i: f for f, i in by.items()})
    assert {i: got.get(i, i) for i in want} == want
    assert n < 100 * len(by)


def test_components_of_a_long_chain(spark):
    e = [(i, i + 1) for i in range(1, 300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 301)} == {1} and {got[i] for i in range(1000, 1200)} == {1000}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first_keeps_columns_and_clean_rows(spark, make_docs):
    base = " ".join(f"w{i}" for i in range(200))
    docs = make_docs([(7, base), (3, base), (9, base.upper()), (4, "something else entirely here now"), (5, None), (4, "something else entirely here now"), (None, base)], {"bits": F.lit("x"), "component_id": F.lit(1)})
    out = S.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [3, 4, 5, None]
    assert S.keep_first(docs.limit(0)).count() == 0
