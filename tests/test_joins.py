"""As-of joins, novelty, near duplicates and rank tests against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as B, dedup as D, novelty as V, stats as ST
from tidemark.operators.asof import asof


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    left = [(s, int(t), i) for i, (s, t) in enumerate(zip(rng.choice(["a", "b", "c"], 400, p=[0.8, 0.15, 0.05]), rng.integers(-500, 1500, 400)))]
    right = sorted({(s, int(t)) for s, t in zip(rng.choice(["a", "b"], 60), rng.integers(0, 1000, 60))})
    return left, [(s, t, float(i)) for i, (s, t) in enumerate(right)]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("width", [7, 100, 10**6])
@pytest.mark.parametrize("tol", [None, 20])
def test_asof_equals_brute_force(spark, sides, forward, width, tol):
    left, right = sides
    ld = spark.createDataFrame(left, "k string, t long, id int")
    rd = spark.createDataFrame(right, "k string, t long, v double")
    got = {r.id: (r.hit_t, r.v) for r in asof(ld, rd, ["k"], ["v"], forward=forward, tolerance_us=tol, width_us=width).collect()}
    for k, t, i in left:
        c = [(rt, v) for rk, rt, v in right if rk == k and (rt >= t if forward else rt <= t)]
        best = (min(c) if forward else max(c)) if c else (None, None)
        if tol is not None and best[0] is not None and abs(best[0] - t) > tol:
            best = (None, None)
        assert got[i] == best
    assert len(got) == len(left)


def test_snapped_asof_with_a_hot_time(spark):
    ld = spark.createDataFrame([("a", 11, i) for i in range(300)] + [("a", 20, 300), ("a", 21, 301)], "k string, t long, id int")
    rd = spark.createDataFrame([("a", 10 * i, float(i)) for i in (0, 2, 5)], "k string, t long, v double")
    got = {r.id: r.v for r in asof(ld, rd, ["k"], ["v"], forward=True, snap_us=10).collect()}
    assert set(got[i] for i in range(301)) == {2.0} and got[301] == 5.0


def test_asof_plan_has_no_theta_join(spark, sides):
    left, right = sides
    d = asof(spark.createDataFrame(left, "k string, t long, id int"), spark.createDataFrame(right, "k string, t long, v double"), ["k"], ["v"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_novelty_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 300
    vec = rng.normal(size=(n, 8))
    vec[7] = vec[3] * 2  # same direction
    vec[50] = 0
    key = rng.choice(["a", "b"], n, p=[0.9, 0.1])
    t = np.sort(rng.integers(0, 2000, n))
    t[20:40] = t[20]  # many at one time
    rows = [(str(key[i]), i, int(t[i]), [float(x) for x in vec[i]]) for i in range(n)]
    d = V.novelty(spark.createDataFrame(rows, "k string, id long, t long, vec array<double>"), ["k"], window_us=150, size=16)
    got = {r.id: (r.novelty, r.news_count_24h) for r in d.collect()}
    norm = vec / np.where(np.linalg.norm(vec, axis=1) == 0, 1, np.linalg.norm(vec, axis=1))[:, None]
    for i in range(n):
        prev = [j for j in range(n) if key[j] == key[i] and (t[j], j) < (t[i], i) and t[j] >= t[i] - 150]
        want = 1 - max((norm[j] @ norm[i] for j in prev), default=0.0)
        assert got[i][0] == pytest.approx(want, abs=1e-12)
        assert got[i][1] == len(prev)


def greedy(texts, threshold, stop):
    import math
    import re
    from collections import Counter

    toks = [Counter(w for w in re.findall(r"[^\W]{2,}", x.lower()) if w not in stop) for x in texts]
    n = len(texts)
    df = Counter(w for c in toks for w in c)
    vec = []
    for c in toks:
        w = {k: v * (math.log((1 + n) / (1 + df[k])) + 1) for k, v in c.items()}
        z = math.sqrt(sum(v * v for v in w.values())) or 1.0
        vec.append({k: v / z for k, v in w.items()})
    kept = []
    for i in range(n):
        if not any(sum(x * vec[j].get(k, 0.0) for k, x in vec[i].items()) >= threshold - 1e-12 for j in kept):
            kept.append(i)
    return kept


def near_copies():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    base = [list(rng.choice(words, 12)) for _ in range(12)]
    texts = []
    for i in range(120):
        # A third of all texts are near copies of the first base text.
        b = list(base[0] if i % 3 == 0 else base[rng.integers(0, 12)])
        for _ in range(rng.integers(0, 4)):
            b[rng.integers(0, len(b))] = rng.choice(words)
        texts.append(" ".join(b))
    texts[5] = texts[80] = "!!"  # no tokens: always stay
    texts[17] = texts[2]
    return texts


@pytest.mark.parametrize(("load", "first", "block"), [(10**9, 256, 1024), (1, 16, 1024), (0, 32, 3)])
def test_near_duplicates_equal_the_greedy_walk(spark, load, first, block, monkeypatch):
    ends = []
    batch_end = D.batch_end

    def watched(*args):
        ends.append(batch_end(*args))
        return ends[-1]

    monkeypatch.setattr(D, "batch_end", watched)
    monkeypatch.setattr(D, "BLOCK", block)
    texts = near_copies()
    d = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = sorted(r.i for r in D.drop_near_duplicates(d, "i", "text", 0.85, ["w0"], load, first).collect())
    assert got == greedy(texts, 0.85, {"w0"})
    assert ends[-1] is None and (len(ends) == 1) == (load == 10**9)


def test_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """400 near copies in a row: each meets the first of its batch, not all the others."""
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in range(400)]
    base = list(rng.choice(words, 60, replace=False))
    texts = []
    for i in range(400):
        gone = {i % 60, (i + 1 + i // 60) % 60}
        texts.append(" ".join(w for k, w in enumerate(base) if k not in gone))
    pairs = []
    candidates = D.candidates

    def counted(*args):
        out = candidates(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(D, "candidates", counted)
    d = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    assert [r.i for r in D.drop_near_duplicates(d, "i", "text", 0.85, [], 1, 16).collect()] == [0]
    assert sum(pairs) < 1500


def test_spearman_and_kruskal_by_hand(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, 400).astype(float)
    y = x + rng.integers(0, 6, 400)
    d = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)], "k string, x double, y double")

    def rank(v):
        s = np.sort(v)
        return (np.searchsorted(s, v, "left") + np.searchsorted(s, v, "right") + 1) / 2

    r = ST.spearman(d, ["k"], "x", "y").first()
    assert r.rho == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=1e-12)
    h = ST.with_chi2_p(ST.kruskal(d, ["k"], "y", "x")).first()
    rk, n = rank(y), len(y)
    raw = 12 / (n * (n + 1)) * sum(rk[x == g].sum() ** 2 / (x == g).sum() for g in np.unique(x)) - 3 * (n + 1)
    ties = sum(c**3 - c for c in np.unique(y, return_counts=True)[1])
    assert h.h == pytest.approx(raw / (1 - ties / (n**3 - n))) and h.dof == len(np.unique(x)) - 1
    assert 0 <= h.p_value < 1e-6


@pytest.mark.parametrize("n", [50, 3000])
def test_hac_equals_the_lag_loop(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n).cumsum()
    y = 0.1 * x + rng.normal(size=n)
    gone = rng.random(n) < 0.1
    rows = [("a", i, float(x[i]), None if gone[i] else float(y[i])) for i in range(n)]
    r = ST.ols_hac(spark.createDataFrame(rows, "k string, t long, x double, y double"), ["k"], "t", "x", "y", 24, 100).first()
    xs, ys = x[~gone], y[~gone]
    A = np.column_stack([np.ones(len(xs)), xs])
    beta = np.linalg.lstsq(A, ys, rcond=None)[0]
    e = ys - A @ beta
    u = A * e[:, None]
    Sm = u.T @ u
    for lag in range(1, 25):
        g = u[lag:].T @ u[:-lag]
        Sm = Sm + (1 - lag / 25) * (g + g.T)
    inv = np.linalg.inv(A.T @ A)
    t = beta[1] / np.sqrt((inv @ Sm @ inv)[1, 1])
    assert r.slope == pytest.approx(beta[1], rel=1e-9) and r.t_hac == pytest.approx(t, rel=1e-6) and r.n == len(xs)


def test_bootstrap_of_equal_variants_is_zero(spark):
    rows = [("s", v, 1, d, 10, 4 + d % 3, 1.0, 1.0) for d in range(20) for v in "ab"]
    daily = spark.createDataFrame(rows, "symbol string, variant string, horizon int, day int, n long, n_dir_correct long, sum_abs_err double, sum_abs_actual double")
    out = {r.horizon: r for r in B.block_bootstrap(daily, "a", "b", [1], 7, 50, 0).collect()}
    assert set(out) == {"1", "pooled"}
    assert out["pooled"].delta_da_pp == 0 and out["pooled"].ci_lo_pp == 0 and out["pooled"].p_delta_gt_0 == 0


def test_bootstrap_equals_a_direct_draw(spark):
    import hashlib

    rng = np.random.default_rng(9)
    D_, blk, boot = 17, 5, 40
    n = rng.integers(5, 20, (2, D_))
    c = np.minimum(rng.integers(0, 15, (2, D_)), n)
    rows = [("s", "ab"[v], 1, d, int(n[v, d]), int(c[v, d]), 1.0, 1.0) for d in range(D_) for v in (0, 1)]
    daily = spark.createDataFrame(rows, "symbol string, variant string, horizon int, day int, n long, n_dir_correct long, sum_abs_err double, sum_abs_actual double")
    r = B.block_bootstrap(daily, "a", "b", [1], blk, boot, 3).filter("horizon = 'pooled'").first()
    nb = -(-D_ // blk)
    deltas = []
    for k in range(boot):
        ix = []
        for s in range(nb):
            st = int(hashlib.md5(f"3:{k}:{s}".encode()).hexdigest()[:8], 16) % (D_ - blk + 1)
            ix += range(st, st + blk)
        ix = ix[:D_]
        deltas.append(c[1, ix].sum() / n[1, ix].sum() - c[0, ix].sum() / n[0, ix].sum())
    assert r.ci_lo_pp == pytest.approx(np.percentile(deltas, 2.5) * 100)
    assert r.ci_hi_pp == pytest.approx(np.percentile(deltas, 97.5) * 100)
    assert r.p_delta_gt_0 == pytest.approx(np.mean(np.array(deltas) > 0))
