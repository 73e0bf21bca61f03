import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    hit = set()
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for i, r in enumerate(runs):
        if runs.count(r) > 1:
            hit |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


TEXTS = [None, "", " \n\t ", "a b c a b c", "x\nx\n\n\n x\nx ", "é\xa0ü #* <b>|&", "a b a b a b a b", "one two three " * 40, "日 本\x1c語 x"]


def test_counts_against_plain_code(sf, spark):
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + TEXTS
    for t in rows:
        assert R.statistics(None if t is None else t.encode())[:5] == plain(t)


def test_a_lone_row_has_a_short_path():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(255, 2)), [[9.0, 9.0]]]
    forest = [np.array(R.grow(x, rng, 8)) for _ in range(50)]
    s = R.forest_score(x, forest, 256)
    assert s[-1] == s.max() and s[-1] > 0.65 > 0.55 > np.median(s)
    assert all(0 < v < 1 for v in s)


def test_cut_follows_the_labels():
    assert R.best_cut({}) is None
    assert R.best_cut({(400, 1): 50, (700, 0): 5}) == 0.7
    assert R.best_cut({(700, 1): 50, (700, 0): 5}) is None


@pytest.fixture
def corpus(make_docs, spark):
    rnd = random.Random(5)
    good = [" ".join(rnd.choice(["the", "of", f"read{rnd.randint(0, 99)}", f"sand{rnd.randint(0, 999)}", "in", f"heath{rnd.randint(0, 99)}.", "to,"]) for _ in range(rnd.randint(60, 200))) for _ in range(300)]
    junk = [" ".join(rnd.choice(["zzz###", "qqqqqq$$$", "wwwww%%%"]) + str(i) for i in range(80)) for _ in range(25)]
    docs = make_docs(good + junk, {"score": F.lit("x"), "kept": F.lit(0)})
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(i, 0) for i in range(300, 325, 2)] + [(1, None)], "doc_id long, quality int")
    return docs, labels


def test_junk_goes_and_clean_stays(corpus):
    docs, labels = corpus
    got = {r.doc_id: r.kept for r in R.judged(docs, labels).collect()}
    assert sum(got[i] for i in range(300)) >= 297 and sum(got[i] for i in range(300, 325)) <= 1
    again = {r.doc_id: r.kept for r in R.judged(docs.repartition(7), labels).collect()}
    assert again == got
    kept = R.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i]}


def test_odd_rows(make_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = make_docs(TEXTS + ["w " * 60000, "a b c d e f g h i j " * 4 + " ".join(f"w{i}" for i in range(50))])
    got = {r.doc_id: r for r in R.judged(docs.unionAll(docs), labels).collect()}
    assert not any(got[i].kept for i in range(len(TEXTS) + 1)) and got[len(TEXTS) + 1].kept
    assert R.judged(docs.limit(0), labels).count() == 0
    fine = " ".join(f"v{i}" for i in range(60))
    odd = make_docs([(None, "w " * 60), (None, fine), (None, None), (3, None), (4, fine), (4, fine)], {"score": F.lit(1), "kept": F.lit("x")})
    kept = R.keep_good(odd, labels)
    assert kept.columns == odd.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 4), (False, 4), (True, None)]


def test_few_clean_documents_all_stay(make_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for n in range(1, 11):
        docs = make_docs([" ".join(f"w{i}x{k}" for k in range(120)) for i in range(n)])
        assert R.judged(docs, labels, trees=16).where("kept").count() == n
        assert R.keep_good(docs, labels, trees=16).count() == n


def path(x, nodes):
    """Length of one row's path, walked node by node."""
    at = 0
    while nodes[at][0] >= 0:
        f, cut, left, right, _ = nodes[at]
        at = left if x[f] < cut else right
    return nodes[at][4]


def test_verdict_against_plain_code(corpus):
    docs, labels = corpus
    rows = {r.doc_id: R.statistics(r.text.encode()) for r in docs.collect()}
    by_id = {}
    for d, (n, chars, symbols, _, _, short, stops, top) in rows.items():
        by_id[d] = [chars / n, symbols / max(chars, 1), short / n, stops / n, top / n]
    stats = R.rule_counts(docs)
    h = {r.doc_id: r.h for r in stats.select("doc_id", F.xxhash64(F.lit(R.SEED), "doc_id", *R.STATS).alias("h")).collect()}
    pool = np.array([by_id[d] for d in sorted(by_id, key=h.get) if rows[d][0] >= 50 and 2 * rows[d][4] <= rows[d][0]])
    trees = []
    for t in range(24):
        x, rng = R.draw(pool, t)
        assert len(x) == -(-len(pool) // 4)
        trees.append(R.grow(x, rng, int(np.ceil(np.log2(len(x))))))
    size = len(x)
    want = {d: 2 ** (-sum(path(x, t) for t in trees) / len(trees) / R.mean_path(size)) for d, x in by_id.items()}
    got = {r.doc_id: r for r in R.judged(docs, labels, trees=24).collect()}
    assert all(got[d].score == pytest.approx(want[d], abs=1e-12) for d in want)
    quality = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    passed = [d for d in want if not got[d].base_failed]
    good, bad = ([want[d] for d in passed if quality.get(d) == q] for q in (1, 0))

    def gain(c):
        return sum(int(s * 1000) >= c for s in bad) / len(bad) - 20 * sum(int(s * 1000) >= c for s in good) / len(good)

    cut = max(range(1001), key=lambda c: (gain(c), c))
    assert {d for d in got if got[d].kept} == {d for d in passed if gain(cut) <= 0 or int(want[d] * 1000) < cut}
