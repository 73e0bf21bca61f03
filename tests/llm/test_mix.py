import math
import random

from oracle import compare, connect
from pyspark.sql import functions as F

from tidemark.llm import mix, queries


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / (sum(w[s] for s in rest) or 1)
        over = {s for s in rest if level * w[s] > most * sizes[s]}
        if not over:
            return {s: min(most * sizes[s], level * w[s]) for s in names}
        full |= over


def corpus(seed, n=300):
    rnd = random.Random(seed)
    src = ["hot"] * 100 + ["a", "b", "Z", "é", None, "tiny"] * 3 + ["c"] * 20
    rows = []
    for i in range(n):
        s = rnd.choice(src)
        rows.append((i, " ".join("w" * rnd.randint(1, 5) for _ in range(2 if s == "tiny" else rnd.choice([0, 5, 50, 400]))), "en", s))
    return rows


def test_targets_and_taken(spark, make_docs):
    docs = make_docs(corpus(1) + [(900, None), (901, "", "en", "empty"), (902, None, "en", "nothing")], {"target": F.lit("x")})
    rows = mix.mixed(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = water(sizes)
    assert len(rows) == docs.count()
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(math.isclose(r.target, want[s], rel_tol=1e-12) and r.source_size == sizes[s] for r in mine)
        assert 0 <= want[s] - sum(r.taken for r in mine) < 1
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    again = mix.mixed(docs.repartition(13)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_complete_epochs_come_first_and_keys_decide(spark, make_docs):
    rows = [r for r in mix.mixed(make_docs(corpus(2))).collect() if r["size"]]
    for s in {r.source for r in rows}:
        mine = sorted((r for r in rows if r.source == s), key=lambda r: (r.key, r.doc_id))
        times = [r.taken / r["size"] for r in mine]
        assert times == sorted(times, reverse=True) and max(times) - min(times) <= 1


def test_heavier_documents_come_earlier(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    ks = df.select("w", mix.exponential_key("doc_id", "w").alias("k")).orderBy("k").limit(1000).groupBy("w").count().collect()
    share = {r.w: r["count"] / 1000 for r in ks}
    assert 0.68 < share[3.0] < 0.82


def test_running_sum_splits_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 37 % 5000).alias("o"), F.col("id").alias("v"))
    got = {(r.g, r.o): r.s for r in mix.running_sum(df, "g", ["o"], "v", "s").collect()}
    acc = {}
    for r in sorted(df.collect(), key=lambda r: (r.g, r.o)):
        assert got[r.g, r.o] == acc.get(r.g, 0)
        acc[r.g] = acc.get(r.g, 0) + r.v


def test_copies_are_whole_documents(spark, make_docs):
    docs = make_docs(corpus(3) + [(7, "same same"), (7, "same same"), (None, "no id here")])
    out = mix.copies(docs)
    assert out.columns == docs.columns
    want = {}
    for r in mix.mixed(docs, whole=True).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + (r.taken // r["size"] if r["size"] else 0)
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert mix.copies(docs.limit(0)).count() == 0 and mix.mixed(docs.limit(0)).count() == 0


def test_same_rows_as_sql(spark, sf):
    got = queries.QUERIES["op4_source_mix"](spark, sf)
    rel = connect(sf).execute(mix.SQL)
    cols = [d[0] for d in rel.description]
    diff = compare(got.columns, got.collect(), cols, rel.fetchall())
    assert diff is None or diff.startswith("last digits"), diff
