"""Windows over blocks give what windows over the whole key give, across many blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from tidemark import tables as T
from tidemark.operators import features as X, targets as Y
from tidemark.operators.blocks import bucket_offsets, with_halo, with_position, with_time_halo

FIVE = 5 * T.MINUTE


@pytest.fixture(scope="module")
def bars(spark):
    """Five-minute bars of the largest table: thousands of rows per symbol, many gaps."""
    return T.ohlcv(T.trades(spark, "/root/testdata/sf0.1").filter("price > 0"), FIVE).cache()


@pytest.fixture(scope="module")
def one(bars):
    return bars.filter("symbol = 'view'").toPandas().sort_values("t").reset_index(drop=True)


def test_there_are_many_blocks(one):
    assert len(one) > 4 * X.BLOCK_ROWS


def test_position_equals_row_number(bars):
    d = with_position(bars, ["symbol"], "t", T.DAY)
    w = W.partitionBy("symbol").orderBy("t")
    e = d.withColumn("rn", F.row_number().over(w) - 1)
    assert e.filter("rn <> pos").count() == 0
    assert e.count() == bars.count()


def test_offsets_are_earlier_totals(spark):
    d = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 2, 5), ("a", 7, 1), ("b", 3, 4)], "k string, b long, v long")
    got = {(r.k, r.b): r.s for r in bucket_offsets(d, ["k"], "b", s=F.sum("v")).collect()}
    assert got == {("a", 0): 0, ("a", 2): 3, ("a", 7): 8, ("b", 3): 0}


def test_halo_repeats_only_what_is_reached(spark):
    d = spark.range(100).select(F.col("id").alias("pos"))
    h = with_halo(d, "pos", before=3, after=2, size=10).toPandas()
    assert h[h.own].pos.tolist().__len__() == 100
    b = h[h.blk == 4].pos
    assert (b.min(), b.max()) == (37, 51)


def test_time_halo_handles_negative_times(spark):
    d = spark.createDataFrame([(-25,), (-1,), (0,), (9,)], "t long")
    h = with_time_halo(d, "t", 10, before=5).toPandas()
    assert set(h[h.own].apply(lambda r: (r.t, r.blk), axis=1)) == {(-25, -3), (-1, -1), (0, 0), (9, 0)}
    assert ((h.t == -1) & (h.blk == 0)).any()


def test_features_equal_pandas(bars, one):
    got = X.features(bars, FIVE).filter("symbol = 'view'").toPandas().sort_values("t").reset_index(drop=True)
    c, v, hi, lo = one.close, one.volume, one.high, one.low
    ret = np.log(c / c.shift(1))

    def same(col, want, tol=1e-9):
        a, b = got[col].astype(float).to_numpy(), np.asarray(want, dtype=float)
        assert (np.isnan(a) == np.isnan(b)).all(), col
        ok = ~np.isnan(a)
        np.testing.assert_allclose(a[ok], b[ok], rtol=tol, atol=1e-9, err_msg=col)

    for k in (1, 24):
        same(f"ret_lag_{k}", ret.shift(k))
        same(f"vol_lag_{k}", v.shift(k))
    for n in X.ROLLING:
        same(f"ret_mean_{n}", ret.rolling(n).mean(), 1e-7)
        same(f"ret_std_{n}", ret.rolling(n).std(), 1e-7)
        same(f"vol_min_{n}", v.rolling(n).min())
        same(f"vol_max_{n}", v.rolling(n).max())
    fast = c.ewm(span=12, adjust=False, min_periods=12).mean()
    slow = c.ewm(span=26, adjust=False, min_periods=26).mean()
    macd = fast - slow
    sig = macd.ewm(span=9, adjust=False, min_periods=9).mean()
    same("macd", macd)
    same("macd_signal", sig)
    same("macd_diff", macd - sig)
    step = c.diff()
    up = step.where(step > 0, 0.0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    dn = (-step).where(step < 0, 0.0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    same("rsi", 100 - 100 / (1 + up / dn))
    tr = pd.concat([hi - lo, (hi - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    atr = np.zeros(len(c))
    atr[13] = tr[:14].mean()
    for i in range(14, len(c)):
        atr[i] = (atr[i - 1] * 13 + tr[i]) / 14
    same("atr", atr)
    sv = np.sign(step) * v
    same("obv_roc_36", sv.rolling(36).sum() / v.rolling(36).sum(), 1e-7)
    same("bb_width", 4 * c.rolling(20).std(ddof=0) / c.rolling(20).mean(), 1e-7)


def test_no_look_ahead(bars, one):
    """Features of a prefix equal the prefix of the features."""
    cut = int(one.t.iloc[3000])
    full = X.features(bars, FIVE).filter((F.col("symbol") == "view") & (F.col("t") <= cut))
    pre = X.features(bars.filter(F.col("t") <= cut), FIVE).filter("symbol = 'view'")
    a, b = (d.select("t", "rsi", "macd_signal", "atr", "ret_std_144", "vol_mean_36").toPandas().sort_values("t") for d in (full, pre))
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-12, atol=1e-12)


def test_targets_equal_exact_lookup(bars, one):
    got = Y.targets(bars, (1, 12, 288), FIVE).filter("symbol = 'view'").toPandas().set_index("t")
    close = one.set_index("t").close
    for h in (1, 12, 288):
        want = np.log(close.reindex(close.index + h * FIVE).to_numpy() / close.to_numpy())
        np.testing.assert_allclose(got.loc[close.index, f"r_{h}"].astype(float), want, atol=1e-12)


def test_dataset_targets_equal_targets(bars):
    hs = (1, 12, 288)
    a = Y.dataset(bars, hs, interval_us=FIVE).select("symbol", "t", *[f"r_{h}" for h in hs])
    b = Y.targets(bars, hs, FIVE).select("symbol", "t", *[f"r_{h}" for h in hs])
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_feature_list():
    assert len(X.FEATURES) == 93 and len(set(X.FEATURES)) == 93
