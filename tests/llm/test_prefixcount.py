import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import prefixcount as P
from tidemark.llm.pieces import load

BITS = ["a", "th", " ", "  ", "\n", "é", "日", "😀", "\t", "0", "ing", "▁", "ﬁ", "<s>", "of", "xxx", "   ", "\x00", "\r", "'", "tion", ""]


def count(text):
    return len(load().lib.encode(text))


def test_every_prefix_is_exact():
    rnd, c = random.Random(3), P.PrefixCounts(load())
    for _ in range(600):
        s = "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 16)))
        assert c.prefixes(s).tolist() == [count(s[:i]) for i in range(len(s) + 1)], repr(s)


def test_counts_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in P.token_counts(docs, 300).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len(r.text.encode()), count(r.text), count(r.text) > 300)
        fits = g.fits_chars
        assert count(r.text[:fits]) <= 300 and (fits == len(r.text) or count(r.text[: fits + 1]) > 300)


def test_odd_rows(spark, make_docs):
    long = "abc def. " * 20000
    docs = make_docs([None, "", " ", long, long], {"n_tokens": F.lit("x")})
    got = [tuple(r) for r in P.token_counts(docs, 4096).orderBy("doc_id").collect()]
    assert [g[2] for g in got] == [0, 0, count(" "), count(long), count(long)] and got[3][3] is True
    assert P.token_counts(docs.limit(0), 5).count() == 0
    assert P.prefix_counts(docs.where("doc_id < 2")).collect()[0].prefix_tokens == [0]


def test_budget_is_the_last_prefix_that_fits():
    assert P.longest_within(np.array([0, 1, 2, 1, 3]), 1) == 3
