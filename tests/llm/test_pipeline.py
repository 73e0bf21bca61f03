import random

import corpus_pipeline
from tidemark.llm import mix, rules

SYL = ["the", "ing", "er", "on", "an", "sh", "re", "ti"]


def sentence(rnd, n=9):
    words = ["".join(rnd.choice(SYL) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
    return " ".join(words) + rnd.choice([".", ".", ", so."])


def corpus(rnd):
    """Clean texts, tables of symbols, exact copies, and one passage in many texts."""
    clean = [(i, " ".join(sentence(rnd) for _ in range(rnd.randint(12, 25)))) for i in range(120)]
    shared = " ".join(sentence(rnd) for _ in range(8))
    with_passage = [(200 + i, f"{' '.join(sentence(rnd) for _ in range(9))} {shared} {' '.join(sentence(rnd) for _ in range(9))}") for i in range(10)]
    junk = [(300 + i, " ".join("".join(rnd.choice("abcdefgh") for _ in range(7)) + "###" for _ in range(90))) for i in range(15)]
    copies = [(400 + i, clean[i][1]) for i in range(8)]
    short = [(500, "too short."), (501, None), (502, "")]
    return clean, shared, with_passage, junk, copies, short


def test_each_stage_does_its_work(spark, make_docs, tmp_path):
    rnd = random.Random(12)
    clean, shared, with_passage, junk, copies, short = corpus(rnd)
    rows = [(d, t, "en", f"src{d % 3}") for d, t in clean + with_passage + junk + copies + short]
    docs = make_docs(rows)
    labels = [(d, 1, 0) for d, _ in clean[::2]] + [(d, 0, 0) for d, _ in junk[::2]]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    sf, at, seen = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        assert name == "piece_encoding" or at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at.collect()
    ids = {k: sorted({r.doc_id for r in v}) for k, v in seen.items()}

    good = [d for d, _ in clean + with_passage + copies]
    assert set(ids["quality_rules"]) <= set(good) and len(ids["quality_rules"]) >= 0.95 * len(good)
    assert not set(ids["near_dedup"]) & {d for d, _ in copies if d - 400 in ids["quality_rules"]}
    assert {r.doc_id: r.text for r in seen["near_dedup"]}.items() <= dict(clean + with_passage + copies).items()
    holders = [r.doc_id for r in seen["passage_dedup"] if shared in r.text]
    assert holders == [min(d for d, _ in with_passage if d in ids["near_dedup"])]
    assert all(r.text == dict(clean)[r.doc_id] for r in seen["passage_dedup"] if r.doc_id < 200)

    before = spark.read.parquet(f"{tmp_path}/passage_dedup")
    want = {r.doc_id: r.taken // r["size"] for r in mix.mixed(before, whole=True).collect()}
    got = {}
    for r in seen["source_mix"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in want.items() if n}
    assert len(seen["piece_encoding"]) == len(seen["source_mix"]) and all(r.round_trip and len(r.piece_ids) for r in seen["piece_encoding"])

    whole = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in seen["piece_encoding"])


def test_empty_documents(spark, make_docs, tmp_path):
    make_docs(["x"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_stages_are_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "passage_dedup", "source_mix", "piece_encoding"]
    assert rules.TREES * rules.SUBSAMPLE <= 1 << 15
