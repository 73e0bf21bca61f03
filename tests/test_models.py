"""Models on planted signals, tails on known values, streams with late rows."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import dist
from tidemark.operators import features as X, models as MO
from tidemark.session import fresh_dir
from tidemark.streaming import jobs as J


def test_tails():
    assert dist.t_quantile(0.975, 9) == pytest.approx(2.2621571627, abs=1e-8)
    assert dist.t_quantile(0.8, 8) == pytest.approx(0.88888952, abs=1e-7)
    assert dist.t_two_sided(2.2621571627, 9) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_two_sided(0.0, 5) == pytest.approx(1.0)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n = 2000
    x = rng.normal(size=(n, 2))
    y = 0.05 * x[:, 0] + rng.normal(scale=0.01, size=n)
    rows = [(float(a) if i % 20 else None, float(b), float(v) if i % 50 else None) for i, ((a, b), v) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "x1 double, x2 double, r_1 double")
    return MO.with_vector(d, ["x1", "x2"]).cache()


def test_point_model_beats_zero(planted):
    m = MO.fit_horizons(planted, [1], maxIter=8, stepSize=0.3, maxDepth=4, minInstancesPerNode=20)
    d = MO.predict_horizons(m, planted)
    r = d.agg(F.avg(F.abs(F.col("r_1") - F.col("r_1_pred"))), F.avg(F.abs("r_1")), F.count("r_1_pred")).first()
    assert r[0] < 0.7 * r[1] and r[2] == 2000
    top = MO.importances(m[1], ["x1", "x2"])
    assert top[0]["gain"] > top[1]["gain"]
    p = MO.prefix_predictions(m[1], planted, (2, 8), "k").agg(F.max(F.abs(F.col("k_8") - F.col("k_2")))).first()[0]
    full = MO.prefix_predictions(m[1], d, (8,), "k").agg(F.max(F.abs(F.col("k_8") - F.col("r_1_pred")))).first()[0]
    assert p > 0 and full < 1e-12


@pytest.mark.parametrize("q", [0.1, 0.9])
def test_quantile_model_is_calibrated(planted, q):
    m = MO.fit_quantile(planted, "r_1", q, trees=6, rate=0.4, depth=3, min_rows=20)
    d = m.predict(planted, "p").filter("r_1 is not null")
    cov, loss, flat = d.agg(
        F.avg((F.col("r_1") <= F.col("p")).cast("int")),
        F.avg(F.greatest(q * (F.col("r_1") - F.col("p")), (q - 1) * (F.col("r_1") - F.col("p")))),
        F.avg(F.greatest(q * (F.col("r_1") - m.start), (q - 1) * (F.col("r_1") - m.start))),
    ).first()
    assert abs(cov - q) < 0.06 and loss < 0.7 * flat


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_late_trades_do_not_reopen_a_closed_bar(spark):
    path = fresh_dir(spark, "late")
    schema = "symbol string, ts timestamp_ntz, seq long, price double, qty double"
    t = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    m = dt.timedelta(minutes=1)
    _write(spark, path, [("a", t + 5 * m, 1, 1.0, 1.0), ("a", t + 50 * m, 2, 3.0, 1.0)], schema)
    src = lambda: J.bars_stream(J.stream_table(spark, path))
    out, ck = fresh_dir(spark, "bars"), fresh_dir(spark, "ck")
    J.run(src(), out, ck)
    _write(spark, path, [("a", t + 2 * h + 30 * m, 3, 5.0, 1.0)], schema)
    J.run(src(), out, ck)
    _write(spark, path, [("a", t + 10 * m, 4, 99.0, 1.0), ("a", t + 4 * h, 5, 6.0, 1.0)], schema)
    d = J.run(src(), out, ck).orderBy("ts").collect()
    assert [(r.ts, r.open, r.close, r.high, r.volume) for r in d] == [(t, 1.0, 3.0, 3.0, 2.0), (t + 2 * h, 5.0, 5.0, 5.0, 1.0)]


def test_serving_features_go_on_after_a_crash(spark):
    """Three batches of candles; the second fails once after its rows were written, and is run again from the state before it."""
    base, src, ck = fresh_dir(spark, "serving"), fresh_dir(spark, "candles"), fresh_dir(spark, "ck")
    schema = "symbol string, t long, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    h = 3_600_000_000

    def rows(symbol, lo, hi):
        t0 = dt.datetime(2024, 1, 1)
        return [(symbol, i * h, t0 + dt.timedelta(hours=i), 1.0, 2.0, 0.5, 1.0 + (i * 7 % 11) / 10, float(i * 5 % 13)) for i in range(lo, hi)]

    batches = [rows("a", 0, 40), rows("b", 0, 3) + rows("a", 40, 55), rows("a", 53, 60) + rows("b", 3, 30)]  # 53 and 54 come again
    job = J.ServingFeatures(spark, base, rows=24)
    write = job.__call__

    class Crash(J.ServingFeatures):
        def __call__(self, both, batch):
            write(both, batch)
            if batch == 1:
                raise RuntimeError("lost")

    crash = Crash(spark, base, rows=24)
    for i, b in enumerate(batches):
        _write(spark, src, b, schema)
        if i == 1:
            with pytest.raises(StreamingQueryException):
                crash.run(J.stream_table(spark, src), ck)
        job.run(J.stream_table(spark, src), ck)
    got = {}
    for r in job.result().orderBy("ts").collect():
        got.setdefault((r.symbol, r.t), []).append(r)
    assert sorted(len(v) for v in got.values()) == [1] * 88 + [2] * 2
    whole = spark.createDataFrame(rows("a", 0, 60) + rows("b", 0, 30), schema)
    want = {(r.symbol, r.t): r for r in X.features(whole).collect()}
    assert want.keys() == got.keys()
    for k, v in got.items():
        for r in v:
            for c in ("ret", "ret_lag_12", "ret_mean_12", "vol_max_12"):
                a, b = r[c], want[k][c]
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12), (k, c)
    assert sorted(os.listdir(base)) == ["features"]


def test_serving_state_holds_few_candles():
    """Candles out of order, repeated and without a time: the newest are kept, as many as asked for."""
    p = J.LastCandles(StructType.fromDDL("symbol string, t long, close double"), 5, 1000)

    class Kept:
        rows: list = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    p.state = Kept()
    first = [("a", i * 37 % 101, float(i)) for i in range(101)] + [("a", None, 0.0)]
    out = list(p.handleInputRows(("a",), iter(first), None))
    assert len(out) == 102 and all(r.is_new for r in out) and [r[1] for r in p.state.rows] == [96, 97, 98, 99, 100]
    out = list(p.handleInputRows(("a",), iter([("a", 98, -1.0), ("a", 95, -2.0)]), None))
    assert [(r.t, r.is_new) for r in out] == [(98, True), (95, True), (96, False), (97, False), (99, False), (100, False)]
    assert [r[1] for r in p.state.rows] == [96, 97, 98, 99, 100] and p.state.rows[2][2] == -1.0


def test_upsert_replay_changes_nothing(spark):
    job = J.UpsertTable(spark, fresh_dir(spark, "up"), ["url"], ["id"])
    a = spark.createDataFrame([("u", 2), ("u", 1), ("v", 3)], "url string, id int")
    b = spark.createDataFrame([("u", 0), ("w", 4)], "url string, id int")
    for rows, n in ((a, 0), (b, 1), (b, 1)):
        job(rows, n)
    assert sorted((r.url, r.id) for r in job.result().collect()) == [("u", 1), ("v", 3), ("w", 4)]


def test_upsert_looks_into_few_runs(spark, monkeypatch):
    """20 batches, merged by threes; every second batch is replayed, one after a crash before its list was written."""
    base = fresh_dir(spark, "up")
    job = J.UpsertTable(spark, base, ["k"], ["v"], buckets=2, fan=3)
    seen = {}
    looked = []
    for b in range(14):
        rows = [(i % (5 + b), 100 * b + i) for i in range(6)] if b != 4 else []
        d = spark.createDataFrame(rows, "k int, v int")
        if b == 7:
            with monkeypatch.context() as m:
                m.setattr(type(spark), "createDataFrame", lambda *a, **k: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    job(d, b)
        job(d, b)
        if b % 4 == 3:
            job(d, b)
        for k, v in rows:
            seen.setdefault(k, v)
        looked.append(len(job.runs(b)))
    assert {r.k: r.v for r in job.result().collect()} == seen and job.result().count() == len(seen)
    assert max(looked) <= 6 and looked[-1] < 6
    left = [p for p in os.listdir(f"{base}/runs")]
    assert len(left) <= len(job.runs(13)) + len(job.runs(12)) and len([p for p in os.listdir(f"{base}/lists") if p.startswith("batch")]) == 2


def test_walk_forward_resumes(spark, planted):
    d = planted.withColumns({"symbol": F.lit("a"), "t": F.monotonically_increasing_id(), "pos": F.monotonically_increasing_id() % 1000})
    folds = [{"symbol": "a", "fold": 0, "train_pos": 0, "train_end_pos": 600, "test_pos": 620, "n_test": 100}]
    path = fresh_dir(spark, "wf")
    p = MO.walk_forward(d, folds, {"vec": []}, [1], path, maxIter=1, maxDepth=2)
    n = p.count()
    again = MO.walk_forward(None_like(d), folds, {"vec": []}, [1], path, maxIter=1)
    assert n > 0 and again.count() == n


class None_like:
    """Stands for data that must not be touched when all tasks are done."""

    def __init__(self, d):
        self.sparkSession = d.sparkSession

    def filter(self, *_):
        raise AssertionError("a finished task was run again")
