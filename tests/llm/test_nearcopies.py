import random

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm import nearcopies as N


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))} for t in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def words(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def edited(rnd, t, n):
    t = list(t)
    for i in rnd.sample(range(len(t)), n):
        t[i] = "".join(rnd.choice("stuvwxyz") for _ in range(6))
    return t


def test_the_stage_drops_near_copies_from_0_8_to_0_95(spark, make_docs):
    rnd = random.Random(3)
    base = [words(rnd, 300) for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base)]
    rows += [(100 + 20 * i + k, " ".join(edited(rnd, t, k))) for i, t in enumerate(base) for k in (2, 4, 6, 9, 12)]
    sim = {d: jaccard(t, rows[(d - 100) // 20][1]) for d, t in rows if d >= 100}
    near, far = {d for d, s in sim.items() if s >= 0.8}, {d for d, s in sim.items() if s < 0.8}
    assert sum(0.8 <= s < 0.9 for s in sim.values()) > 30 and sum(0.9 <= s < 0.96 for s in sim.values()) > 30 and len(far) > 20
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, make_docs(rows).repartition(5), "").collect()}
    assert kept.items() <= dict(rows).items() and set(range(40)) <= set(kept) and not near & set(kept)
    by = {i: [d for d in kept if d >= 100 and (d - 100) // 20 == i] for i in range(40)}
    assert all(jaccard(kept[a], kept[b]) < 0.8 for ds in by.values() for a in ds for b in ds if a < b)
    assert len(kept) > 40  # far ones stay


def test_a_long_bucket_and_odd_rows(spark, make_docs):
    rnd = random.Random(5)
    t = words(rnd, 200)
    rows = [(i, " ".join(edited(rnd, t, 1))) for i in range(60)] + [(100 + i, " ".join(edited(rnd, t, 30))) for i in range(30)]
    docs = make_docs(rows + [(200, None), (201, ""), (None, "a b"), (None, "a b"), (202, "z z z"), (202, "b b b")])
    got = N.keep_first(docs)
    kept = got.collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert got.columns == docs.columns and sorted(ids) == [0, *range(100, 130), 200, 202]
    assert [r.text for r in kept if r.doc_id is None] == ["a b"] * 2 and [r.text for r in kept if r.doc_id == 202] == ["b b b"]
    assert N.keep_first(docs.limit(0)).count() == 0


def test_a_template_makes_few_rounds(spark, make_docs, monkeypatch):
    """300 documents of one template, unlike each other, and two near copies among them."""
    rnd = random.Random(9)
    shared = words(rnd, 160)
    rows = [(i, " ".join(shared[:80] + words(rnd, 45) + shared[80:])) for i in range(300)]
    own = rows[250][1].split()
    rows.append((400, " ".join(edited(rnd, own, 3))))
    assert 0.5 < jaccard(rows[0][1], rows[1][1]) < 0.7 and jaccard(rows[250][1], rows[300][1]) >= 0.8
    rounds = []
    verified = N.verified

    def counted(pairs, sets):
        rounds.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(N, "verified", counted)
    kept = {r.doc_id for r in N.keep_first(make_docs(rows)).collect()}
    assert kept == set(range(300)) and len(rounds) <= 3 and sum(rounds) < 900


def test_against_all_pairs(spark, make_docs):
    """Chains and groups of every similarity: what goes has a near, smaller one; what stays has none that stays."""
    rnd = random.Random(21)
    rows = []
    for g in range(12):
        t = words(rnd, 120)
        for k in range(9):
            rows.append((g * 20 + k, " ".join(t)))
            t = edited(rnd, t, rnd.randint(0, 4))
    docs = make_docs(rows, {"rep": F.lit("r"), "n": F.lit(0), "keys": F.lit(1)})
    kept = {r.doc_id for r in N.keep_first(docs).collect()}
    texts = dict(rows)
    near = {(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8}
    assert not [p for p in near if set(p) <= kept]
    assert {b for b in texts if b not in kept} <= {b for _, b in near}


def test_fingerprints_find_copies_and_the_sets_decide(spark, make_docs, monkeypatch):
    """With the second search off, what SimHash links goes if its shingle sets are near, and only then."""
    rnd = random.Random(11)
    base = [words(rnd, 400) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base)] + [(100 + i, " ".join(edited(rnd, t, 1))) for i, t in enumerate(base)]
    docs = make_docs(rows)
    monkeypatch.setattr(N, "later_copies", lambda lists, sets: None)
    kept = {r.doc_id for r in N.keep_first(docs).collect()}
    assert set(range(20)) <= kept and len(kept) < 35
    monkeypatch.setattr(N, "links", lambda prints: prints.crossJoin(prints.select(F.min("rep").alias("a"))).where("rep <> a").select("a", F.col("rep").alias("b")))
    kept = {r.doc_id for r in N.keep_first(docs).collect()}
    assert kept == {d for d, t in rows if d == 0 or jaccard(rows[0][1], t) < 0.8}


def test_sets_with_much_in_common_that_are_not_near_make_few_pairs(spark, make_docs, monkeypatch):
    """One text with one of 40 words replaced, and one line with own words after it: most are 0.6 to 0.79 alike."""
    rnd = random.Random(4)
    base, line = words(rnd, 40), words(rnd, 30)
    rows = [" ".join(edited(rnd, base, 1)) for _ in range(150)] + [" ".join(line + words(rnd, rnd.randint(5, 11))) for _ in range(150)]
    rnd.shuffle(rows)
    made = []
    verified = N.verified

    def counted(pairs, sets):
        made.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(N, "verified", counted)
    kept = {r.doc_id for r in N.keep_first(make_docs(rows)).collect()}
    shingles = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in map(str.split, rows)]
    near = {(a, b) for b in range(len(rows)) for a in range(b) if 9 * len(shingles[a] & shingles[b]) >= 4 * (len(shingles[a]) + len(shingles[b]))}
    assert not [p for p in near if set(p) <= kept] and set(range(len(rows))) - kept <= {b for _, b in near}
    assert sum(made) < 3 * len(rows) and sum(len(a & b) > 20 for a in shingles[:50] for b in shingles[50:]) > 3000
