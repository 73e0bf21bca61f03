import math
import random
import zlib

from pyspark.sql import functions as F

from tidemark.llm import toxicity as X


def corpus(n=400):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice(["the", "ing", "er", "on", "an"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(20, 80))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(len(words) // 12 + 1):
                words[rnd.randrange(len(words))] = rnd.choice(["scumbo", "zlork" + rnd.choice("abcde"), "vexxu"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_probabilities_add_up():
    counts = {}
    for w, k in [("abab", 0), ("abc", 1), ("bca", 1), ("a", 0)]:
        for g in X.grams(w, 3):
            counts[g, k] = counts.get((g, k), 0) + 1
    m = X.SharedKneserNey(counts, 3)
    chars = set(m.lower[1])
    for k in (0, 1):
        for ctx in ["ab", "zz", "\x02a", "ca"]:
            total = sum(m.prob(k, ctx + c) for c in chars) + m.prob(k, ctx + "q")  # one more kind for what was not seen
            assert math.isclose(total, 1.0) and all(m.prob(k, ctx + c) > 0 for c in chars)
    assert m.ratio("zzq") == 0.0  # unknown to both: one shared estimate


def test_plain_backoff_by_hand():
    m = X.SharedKneserNey({("xa", 0): 3, ("xb", 0): 1, ("xb", 1): 2}, 2, 0.75)
    u = 1 / 3
    low = {c: (1 - 0.75 + 0.75 * 2 * u) / 2 for c in "ab"}
    assert math.isclose(m.prob(0, "xa"), (3 - 0.75 + 0.75 * 2 * low["a"]) / 4)
    assert math.isclose(m.prob(1, "xa"), 0.75 * low["a"] / 2)


def test_held_out_documents(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs(rows + [(900, None), (901, ""), (902, "the er " * 40000), (None, "zlorka zlorkb")], {"score": F.lit("x"), "toxic": F.lit(1)})
    lab = spark.createDataFrame(labels + [(5, None), (7777, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.toxicity(docs, lab).collect()}
    truth = dict(labels)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in truth)
    held = [d for d in truth if got[d].held_out]
    assert sum(got[d].predicted == truth[d] for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[900].ratio == got[901].ratio == 0.0 and got[902].predicted == 0 and got[None].predicted == 1
    twisted = spark.createDataFrame([(d, 1 - k if got[d].held_out else k) for d, k in labels] + [(7777, 1)], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in X.toxicity(docs.repartition(3), twisted).collect()}
    assert all(abs(again[d] - got[d].score) < 1e-9 for d in got)


def test_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in X.toxicity(make_docs(["a b", None]), none).collect()] == [(0.0, 0)] * 2
    assert X.toxicity(make_docs(["a"]).limit(0), none).count() == 0


def test_few_toxic_words_in_every_language(spark, make_docs):
    rnd = random.Random(8)
    syl = {"en": ["the", "ing", "er", "on"], "fr": ["que", "eau", "ois", "lle"], "de": ["sch", "ung", "ein", "ach"], "es": ["cion", "ado", "ll", "que"]}
    rude = {"en": ["scumbo", "vexxu"], "fr": ["zutrix", "zutrox"], "de": ["kwarg", "kwurg"], "es": ["jopaz", "jopuz"]}
    rows, labels = [], {}
    for i in range(1600):
        lang = rnd.choice(["en", "en", "fr", "de", "es"])
        words = ["".join(rnd.choice(syl[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(60, 200))]
        labels[i] = int(rnd.random() < 0.15)
        if labels[i]:
            for _ in range(len(words) // 50 + 1):  # about two words in a hundred
                words[rnd.randrange(len(words))] = rnd.choice(rude[lang]) + rnd.choice(syl[lang])
        rows.append((i, " ".join(words), lang, "src0"))
    got = {r.doc_id: r for r in X.toxicity(make_docs(rows), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    held = [(d, lang) for d, _, lang, _ in rows if got[d].held_out]
    for want in syl:
        toxic = [got[d].predicted for d, lang in held if lang == want and labels[d]]
        clean = [got[d].predicted for d, lang in held if lang == want and not labels[d]]
        assert len(toxic) >= 5 and sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.05 * len(clean), want
