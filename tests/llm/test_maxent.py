import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import maxent as M


def corpus(n=150):
    rnd = random.Random(8)
    langs = [[f"{p}{i}" for i in range(60)] for p in "ab"]
    rows = []
    for i in range(n):
        words = rnd.choice(langs)
        t = " ".join(rnd.choice(words[: rnd.choice([5, 60])]).upper() if rnd.random() < 0.1 else rnd.choice(words[: rnd.choice([5, 60])]) for _ in range(rnd.randint(0, 120)))
        rows.append((i, t + (f" once{i}" if i % 3 == 0 else "")))
    return rows


def plain_base(rows):
    """The contract, over dictionaries."""
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [0]
    c = Counter(w for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 5 != 1 for w in tok(t))
    n, v = sum(c.values()), len(c)
    return n, {d: (len(tok(t)), sum(w in c for w in tok(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t))) for d, t in rows}


@pytest.fixture
def small_head(monkeypatch):
    monkeypatch.setattr(M, "HEAD", 40)  # in this process only: most words then go through the join


def test_base_is_the_contract(spark, make_docs, small_head):
    rows = corpus() + [(900, None), (901, " \n"), (902, "É é\xa0x zzz"), (903, "a1 b2 " * 30000), (None, "a1 none")]
    docs = make_docs(rows, {"score": F.lit("x"), "n": F.lit(1), "key": F.lit(2)})
    n, want = plain_base(rows)
    got = {r.doc_id: r for r in M.scores(docs).collect()}
    assert len(got) == len(rows)
    for d, (k, known, base) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (k, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 5 == 1) and r.score < 0


def test_context_beats_single_words(spark, make_docs):
    got = M.scores(make_docs(corpus(900)).coalesce(2)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b + 0.01 * abs(got.b)


def test_probabilities_add_up_to_one(spark, make_docs):
    table = M.word_counts(make_docs(corpus()))
    c = M.Counts(table)
    rng = np.random.default_rng(0)
    m = M.Model(c)
    m.top[:] = rng.normal(size=m.top.shape)
    m.inner[:] = rng.normal(size=m.inner.shape)
    ev = M.events(np.array([3 << 8 | 7, -1 << 8 | 9, 5 << 8 | 1]), np.array([0]))
    odds = m.class_odds(ev["top"])
    assert np.isclose(sum(M._share(odds, np.full(3, k)) for k in range(M.CLASSES)), 1).all()
    inner = m.word_odds(ev["inner"][:, [0, 2]], ev["cls"][[0, 2]])
    assert np.isclose(sum(M._share(inner, np.full(2, k)) for k in range(M.SLOTS)), 1).all() and (inner[:, int(m.sizes[0]) :] == 0).all()
    # words of a rare class and its one unseen kind share the class
    rare = [r for r in table.collect()]
    top = set(c.keys[: c.out].tolist())
    for k in range(M.RARE):
        mine = [r.n for r in rare if r.key not in top and r.ending % M.RARE == k]
        assert sum(mine) == c.rare_n[k] and len(mine) == c.rare_v[k]
        assert math.isclose(sum(n + 0.5 for n in mine) + 0.5, c.rare_n[k] + 0.5 * (c.rare_v[k] + 1))


def test_steps_move_towards_the_data():
    class C:
        out, head_n, rare_n = 128, np.full(128, 10), np.zeros(M.RARE)

    m = M.Model(C)
    codes = np.array([(i % 2) * 70 << 8 | (i % 2) for i in range(4000)])  # two words take turns
    ev = M.events(codes, np.array([0]))
    before = m.log10(ev).mean()
    seen = [np.zeros(m.top.size, np.float32), np.zeros(m.inner.size, np.float32)]
    for i in range(150):
        m.step(ev, np.random.default_rng(i), seen)
    assert m.log10(ev).mean() > before / 3


def test_sums_and_tails_against_plain_code():
    class C:
        out, head_n, rare_n = M.OUT, np.arange(M.OUT, 0, -1), np.ones(M.RARE)

    rng = np.random.default_rng(4)
    m = M.Model(C)
    m.top[:], m.inner[:] = rng.normal(size=m.top.shape), rng.normal(size=m.inner.shape)
    ends = rng.integers(0, 64, M.OUT + 50)
    place = rng.integers(-1, len(ends), 3000)
    codes = place << 8 | np.where(place < 0, rng.integers(0, 64, 3000), ends[place])
    for starts in ([0], [0, 1, 2, 700, 2999]):
        ev = M.events(codes, np.array(starts))
        assert np.allclose(m.log10(ev, m.sums(ends)), m.log10(ev), rtol=1e-5)
    m.top[:, 3] += 500  # scores whose exp has no float
    ev = M.events(codes, np.array([0]))
    assert np.isfinite(m.class_odds(ev["top"][:, :9])).all() and np.allclose(m.log10(ev, m.sums(ends)), m.log10(ev), rtol=1e-3)

    words = [[b"b", b"a", b"b", b"c"], [b"a"], [b"c", b"b"], [b"b", b"b", M.END]]
    starts, known = np.array([0, 4, 5, 7]), {b"a", M.END}
    vocab = M.Vocabulary(np.array([M.key(w) for w in known]))
    codes, at, _ = M._coded([b"b a b c", b"", b"x"], vocab)
    assert at.tolist() == [0, 5, 6] and (codes >> 8 >= 0).tolist() == [False, True, False, False, True, True, False, True]
    tail = np.array([w not in known for t in words for w in t])
    keys, times = M._tails(words, starts, tail, vocab)
    want = [{M.key(w): t.count(w) for w in t if w not in known} for t in words]
    assert [dict(zip(k, n)) for k, n in zip(keys.to_pylist(), times.to_pylist())] == want
    keys, times = M._tails(words, starts, np.zeros(10, bool), vocab)
    assert keys.to_pylist() == times.to_pylist() == [[]] * 4
    odds = np.array([[1, 0, 2, 1], [0, 1, 0, 0]], np.float32)
    for u, want in ((0.0, [0, 0]), (0.2, [0, 1]), (0.5, [2, 1]), (0.99, [3, 1])):
        assert M._drawn(np.full((2, 1), u, np.float32), odds.copy()).tolist() == want


def test_empty(spark, make_docs):
    assert M.scores(make_docs(["x"]).limit(0)).count() == 0
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    got = M.scores(make_docs([(i, "a b") for i in held])).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.base_score, 0.0) for r in got)


def test_looked_up_rows_are_the_hashed_ones():
    rng = np.random.default_rng(6)
    codes = np.where(rng.random(900) < 0.3, -1, rng.integers(0, 6000, 900)) << 8 | rng.integers(0, 64, 900)
    starts = np.array([0, 1, 5, 400])
    ev = M.events(codes, starts)
    for t in (0, 1, 5, 399, 400, 402, 899):
        first = starts[starts <= t].max()
        end = [int(codes[t - k] & 255) if t - k >= first else 64 for k in (1, 2)]
        words = [(int(codes[t - k]) >> 8, int(codes[t - k]) & 255) if t - k >= first else (-1, 64) for k in (1, 2, 3)]
        i = [p if 0 <= p < M.OUT else M.OUT + e for p, e in words]
        cls = ev["cls"][t]
        want = [M.hashed(1, i[0]), M.hashed(2, end[0]), M.hashed(3, i[0], i[1]), M.hashed(4, i[1]), M.hashed(5, i[2])]
        assert ev["top"][:, t].tolist() == [int(x[0]) for x in want]
        assert ev["inner"][:, t].tolist() == [int(M.hashed(*k)[0]) for k in ((7, end[0], cls), (8, end[1], cls), (9, i[0], cls))]


def test_documents_are_coded_once(spark, make_docs, monkeypatch):
    rows = [(1, "B a b c"), (4, None), (3, "a " * 5 + "zz"), (None, "a"), (9, " \n"), (7, "c c a é")]
    keys = np.array([M.key(b"a"), M.key(M.END)])
    t = M.coded(make_docs(rows).coalesce(1), spark.sparkContext.broadcast(keys), 2)
    assert t.columns == ["row", "doc_id", "part", "size", "codes", "keys", "times"]  # no text is read after this
    got = {r.doc_id: r for r in t.collect()}
    plain, _ = plain_base(rows)
    assert sum(len(r.codes) // 4 for d, r in got.items() if r.part >= 0) == plain and len({r.row for r in got.values()}) == len(rows)
    want = {}
    for d, text in rows:
        raw, r, vocab = (text or "").encode(), got[d], M.Vocabulary(keys)
        want[d] = M._coded([raw], vocab)[0]
        assert np.frombuffer(r.codes, np.int32).tolist() == want[d].tolist() and r.size == len(raw)
        outside = Counter(M.key(w) for w in raw.lower().split() if w != b"a")
        assert dict(zip(r["keys"], r.times)) == outside
        assert r.part in ((-1,) if d is None or zlib.crc32(str(d).encode()) % 5 == 1 else (0, 1))
    monkeypatch.setattr(M, "SLICE", 12)
    pieces = [x for b in t.select("doc_id", "size", "codes").toArrow().to_batches() for x in M._read(b)]
    assert len(pieces) > 2
    for s, codes, starts in pieces:
        for d, mine in zip(s.column("doc_id").to_pylist(), np.split(codes, starts[1:])):
            assert mine.tolist() == want[d].tolist()


def test_draws_are_those_of_the_running_sum():
    rng = np.random.default_rng(2)
    for width in (80, 64):
        odds = rng.random((3000, width), np.float32) ** 8
        odds[rng.random(odds.shape) < 0.5] = 0
        odds[:, 3] = 1e-3
        u = rng.random((3000, 1), np.float32)
        got = M._drawn(u, odds.copy())
        plain = np.cumsum(odds, axis=1, dtype=float)
        assert (odds[np.arange(3000), got] > 0).all()
        assert (got != (plain >= u * plain[:, -1:]).argmax(1)).sum() <= 3  # sums rounded otherwise
    rows = rng.integers(0, 50, (2, 100))
    table, z = rng.normal(size=(50, 8)), rng.normal(size=(100, 8))
    assert np.allclose(M._times(np.exp(z), np.exp(table), rows), M._odds(z.copy(), table, rows))


def test_tokens_keys_and_endings_by_slices_are_those_word_by_word():
    rnd = random.Random(3)
    bits = [b" ", b"\x0b", b"\x1c", b"\n", b"A", b"b", b"c", b"\xc3\x89", b"\xff", b".", b"(", b"'", b"\x00", b"\xc2\xa0", b"\x85"]
    for _ in range(200):
        texts = [None if rnd.random() < 0.1 else b"".join(rnd.choices(bits, k=rnd.randint(0, 30))) for _ in range(rnd.randint(1, 9))]
        words, at, sizes = M.tokens(texts)
        plain = words.to_pylist()
        got = [[plain[i] for i in x] for x in np.split(at, np.cumsum(sizes)[:-1])]
        assert got == [(t or b"").lower().split() + [M.END] for t in texts]
        used = words.take(pa.array(np.unique(at)))
        assert M.keys_of(used).tolist() == [M.key(w) for w in used.to_pylist()]
        assert M.endings(used).tolist() == [xxhash.xxh32_intdigest(w.strip(b".,;:!?\"'()")[-3:] or w[-1:], 3) & 63 for w in used.to_pylist()]
