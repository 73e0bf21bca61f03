"""Hand-written frames for rules that are easy to get wrong."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as M, text as X
from tidemark.operators import evaluation as E, funding as FU, news as N, screens as SC, splits as S, targets as Y, upserts as U
from tidemark.operators import ranks as R, windows as WN
from tidemark.operators.ranks import exact_quantiles, left_closed, right_closed
from tidemark.sources import html as H, payloads as P
from tidemark.sources.files import epoch_to_micros
from tidemark.tables import DAY, HOUR, MINUTE

FIVE = 5 * MINUTE


def candles(spark, rows, step=FIVE):
    """(symbol, slot, close) to candles."""
    d = spark.createDataFrame([(s, k * step, float(c)) for s, k, c in rows], "symbol string, t long, close double")
    return d.withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0),
                          "ts": F.timestamp_micros("t").cast("timestamp_ntz")})


def test_gap_gives_null_target(spark):
    d = Y.targets(candles(spark, [("a", 0, 1), ("a", 2, 2), ("a", 3, 4)]), (1,), FIVE)
    got = {r.t // FIVE: r.r_1 for r in d.collect()}
    assert got[0] is None and got[3] is None
    assert got[2] == pytest.approx(math.log(2))


def test_news_label_steps_by_rows_and_drops_undated_future(spark):
    # Bars at slots 0, 1, 5, 6: two rows after slot 1 is slot 6, whatever the gap.
    bars = candles(spark, [("a", 0, 1), ("a", 1, 10), ("a", 5, 20), ("a", 6, 40)])
    news = spark.createDataFrame([("n1", "a", FIVE - 1), ("n2", "a", FIVE), ("n3", "a", FIVE + 1)], "url string, symbol string, t long")
    got = {r.url: (r.log_return, r.label) for r in Y.label_news(news, bars, steps=2, interval_us=FIVE).collect()}
    assert set(got) == {"n1", "n2"}
    assert got["n1"][0] == pytest.approx(math.log(4)) and got["n1"][1] == "positive"


def test_funding_row_exactly_thirty_days_old_is_out(spark):
    rows = [("a", i * DAY, float(i % 5)) for i in range(31)]
    z = {r.t // DAY: r.f_z for r in FU.funding_z(spark.createDataFrame(rows, "symbol string, t long, rate double")).collect()}
    assert z[28] is None  # 29 rows
    x = np.array([i % 5 for i in range(30)], float)
    assert z[29] == pytest.approx((x[-1] - x.mean()) / x.std(ddof=1))
    x = np.array([i % 5 for i in range(1, 31)], float)
    assert z[30] == pytest.approx((x[-1] - x.mean()) / x.std(ddof=1))


def news_rows(spark, rows):
    return spark.createDataFrame(rows, "symbol string, url string, t long, sentiment_pos double, sentiment_neg double, sentiment_neu double, llm_event_type string")


def test_decay_window_is_closed_and_halves_at_the_half_life(spark):
    t = 100 * HOUR
    news = news_rows(spark, [("a", "x", t - 90 * MINUTE, 0.8, 0.0, 0.2, "hack")])
    grid = candles(spark, [("a", 100, 1), ("a", 123, 1), ("a", 124, 1)], HOUR)
    d = {r.t // HOUR: r for r in N.decay_features(news, grid, ["symbol"], HOUR, {"hack": F.col("llm_event_type") == "hack"}).collect()}
    assert d[100].news_intensity == pytest.approx(0.5)
    assert d[100].sentiment_weighted == pytest.approx(0.4)
    assert d[100].max_magnitude_60m == 0 and not d[100].event_hack_60m
    assert d[123].news_intensity == 0  # 24.5 hours old
    exact = news_rows(spark, [("a", "x", t - 24 * HOUR, 0.5, 0.1, 0.4, None), ("a", "y", t - 60 * MINUTE, 0.0, 0.3, 0.7, "hack")])
    r = [x for x in N.decay_features(exact, grid, ["symbol"], HOUR, {"hack": F.col("llm_event_type") == "hack"}).collect() if x.t == t][0]
    w = np.array([2.0**-16, 2 ** (-60 / 90)])
    s = np.array([0.4, -0.3])
    assert r.news_intensity == pytest.approx(w.sum(), rel=1e-12)
    assert r.sentiment_weighted == pytest.approx((w * s).sum(), rel=1e-12)
    m = (w * s).sum() / w.sum()
    assert r.sentiment_dispersion == pytest.approx(math.sqrt((w * (s - m) ** 2).sum() / w.sum()), rel=1e-9)
    assert r.max_magnitude_60m == pytest.approx(0.3) and r.event_hack_60m


def test_short_half_life_empties_everything(spark):
    # Decay window 16 * 1 minute is over; the item is still inside 60 minutes, yet all is zero.
    t = 50 * MINUTE
    news = news_rows(spark, [("a", "x", t - 30 * MINUTE, 0.8, 0.0, 0.2, "hack")])
    r = N.decay_features(news, candles(spark, [("a", 50, 1)], MINUTE), ["symbol"], MINUTE, {"hack": F.lit(True)}, half_life_min=1.0).first()
    assert (r.news_intensity, r.max_magnitude_60m, r.event_hack_60m) == (0, 0, False)


def test_off_grid_time_is_an_error(spark):
    news = news_rows(spark, [("a", "x", 0, 0.8, 0.0, 0.2, None)])
    grid = spark.createDataFrame([("a", HOUR + 1)], "symbol string, t long")
    with pytest.raises(Exception, match="multiples of the step"):
        N.decay_features(news, grid, ["symbol"], HOUR, {}).collect()


def test_recent_category_ties_and_window(spark):
    t = 10 * HOUR
    news = news_rows(spark, [("a", "u1", t, 0.0, 0.0, 1.0, "hack"), ("a", "u2", t, 0.0, 0.0, 1.0, "macro"), ("a", "u3", t, 0.0, 0.0, 1.0, None)])
    d = {r.t // HOUR: r.recent_category for r in N.recent_category(news, candles(spark, [("a", 9, 1), ("a", 10, 1), ("a", 13, 1), ("a", 14, 1)], HOUR), ["symbol"], HOUR, 180).collect()}
    assert d == {9: "none", 10: "macro", 13: "macro", 14: "none"}


def test_folds_skip_empty_windows_without_using_a_number(spark):
    days = [0, 1, 2, 3, 4, 5, 6, 7, 20, 21]
    rows = spark.createDataFrame([("a", d * DAY) for d in days], "symbol string, t long")
    f = {r.fold: r for r in S.fold_table(rows, 4 * DAY, 4 * DAY, 2).collect()}
    assert sorted(f) == [0, 1]
    assert (f[0].test_start, f[0].n_train, f[0].n_test) == (4 * DAY, 2, 4)
    assert (f[1].test_start, f[1].n_train, f[1].n_test) == (20 * DAY, 6, 2)
    # A window starting exactly at the last row is not a fold.
    g = S.fold_table(spark.createDataFrame([("a", d * DAY) for d in range(9)], "symbol string, t long"), 4 * DAY, 4 * DAY, 1).collect()
    assert len(g) == 1


def test_sliding_train_window(spark):
    rows = spark.createDataFrame([("a", d * DAY) for d in range(30)], "symbol string, t long")
    f = S.fold_table(rows, 10 * DAY, 5 * DAY, 2, 7 * DAY).orderBy("fold").collect()
    assert [(r.train_pos, r.train_end_pos) for r in f] == [(3, 8), (8, 13), (13, 18), (18, 23)]
    d = rows.withColumn("pos", F.col("t") / DAY)
    ft = S.fold_table(rows, 10 * DAY, 5 * DAY, 2, 7 * DAY)
    g = WN.grid(d, ft, ["symbol"], "t", "pos", "train_pos", "train_end_pos")
    n = {r.fold: (r.n_rows, r.q1) for r in WN.quantiles(g, [0.5]).collect()}
    assert n == {k: (5, (5 * k + 5) * DAY) for k in range(4)}


@pytest.mark.parametrize(("margin", "accuracy"), [(2.0, 2000), (2.0, 20), (0.0, 3)])
def test_bracketed_quantiles_against_numpy(spark, margin, accuracy, monkeypatch):
    """Also with a bracket that misses (no margin, a coarse sketch): those groups are done in full."""
    monkeypatch.setattr(R, "MARGIN", margin)
    monkeypatch.setattr(R, "ACCURACY", accuracy)
    rng = np.random.default_rng(6)
    groups = {"big": rng.lognormal(size=3000), "hot": np.r_[np.full(900, 2.0), rng.normal(size=90)], "one": [4.0], "two": [1.0, 2.0]}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("big", None), ("none", None)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.k: r for r in R.bracketed_quantiles(d, ["k"], "v", probs).collect()}
    assert got.keys() == groups.keys()
    for k, xs in groups.items():
        assert got[k].n_rows == len(xs)
        assert [got[k][f"q{i}"] for i in range(1, 6)] == pytest.approx(list(np.quantile(xs, probs)), abs=1e-12)


@pytest.mark.parametrize("most", [8, 4096])
def test_window_quantiles_against_numpy(spark, most, monkeypatch):
    monkeypatch.setattr(WN, "MOST_RANGES", most)
    rng = np.random.default_rng(4)
    rows = [(k, int(i), float(v)) for k, n in (("a", 600), ("b", 40)) for i, v in enumerate(np.round(rng.normal(size=n), 1))]
    rows += [("a", i, 7.0) for i in range(600, 900)] + [("a", 5, None), ("c", 1, 2.0)]
    wins = [("a", f, int(lo), int(lo + rng.integers(0, 300))) for f, lo in enumerate(rng.integers(0, 900, 30))] + [("b", 0, -5, 100), ("b", 1, 7, 8), ("d", 0, 0, 9)]
    d = spark.createDataFrame(rows, "k string, p long, v double")
    w = spark.createDataFrame(wins, "k string, fold int, lo long, hi long")
    g = WN.grid(d, w, ["k"], "v", "p", "lo", "hi", sums={"up": F.count(F.when(F.col("v") > 0, 1))})
    inside = {(k, f): [v for kk, p, v in rows if kk == k and lo <= p < hi and v is not None] for k, f, lo, hi in wins}
    want = {x: (len(v), *np.quantile(v, [0, 1 / 3, 0.9])) for x, v in inside.items() if v}
    got = {(r.k, r.fold): (r.n_rows, r.q1, r.q2, r.q3) for r in WN.quantiles(g, [0, 1 / 3, 0.9]).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)
    edges = spark.createDataFrame([(*x, float(e)) for x in want for e in (-9, -0.3, 0, 7, 8)], "k string, fold int, edge double")
    for r in WN.below(g, edges).collect():
        v = [x for x in inside[r.k, r.fold] if x < r.edge]
        assert (r.n, r.up) == (len(v), sum(x > 0 for x in v))


def test_majority_tie_goes_to_the_smaller_sign(spark):
    d = spark.createDataFrame([(3, 0, 3, 1, 2, 5), (0, 2, 2, 1, 7, 5), (0, 0, 4, 1, 2, 5)],
                              "train_neg int, train_zero int, train_pos int, neg int, zero int, pos int")
    assert [r[0] for r in d.select(E.majority_hits()).collect()] == [1, 7, 5]


def test_zero_with_zero_is_a_hit_and_nulls_do_not_count(spark):
    d = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, -2.0), (None, 1.0)], "a double, p double")
    r = d.select(M.directional_accuracy(F.col("a"), F.col("p")), M.n_pairs(F.col("a"), F.col("p"))).first()
    assert r[0] == pytest.approx(2 / 3) and r[1] == 3


def test_pinball_by_hand(spark):
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0)], "a double, p double")
    assert d.select(M.pinball(F.col("a"), F.col("p"), 0.9)).first()[0] == pytest.approx((0.9 + 0.1) / 2)


def test_pooling_is_weighted_and_drops_empty_folds(spark):
    d = spark.createDataFrame([("a", 1, 0, 1.0, 10), ("a", 1, 1, 3.0, 30), ("a", 1, 2, 99.0, 0)], "symbol string, horizon int, fold int, mae double, n_test int")
    r = E.pool(d, ["mae"], ["symbol", "horizon"]).first()
    assert (r.mae, r.n_folds, r.n_test_total) == (2.5, 2, 40)


def test_two_binning_rules(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,)], "x double")
    edges = [F.lit(float(e)) for e in (0, 1, 1, 2, 3)]
    assert [r[0] for r in d.select(right_closed(F.col("x"), edges)).collect()] == [0, 0, 1, 1, 2]
    assert [r[0] for r in d.select(left_closed(F.col("x"), [F.lit(1.0), F.lit(2.0)])).collect()] == [0, 1, 1, 2, 2]


def test_exact_quantiles_with_hot_values(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(5000, 7.0), rng.normal(7, 3, 10000).round(2)])
    d = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")
    r = exact_quantiles(d, ["k"], "v", [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]).first()
    np.testing.assert_allclose([r[f"q{i}"] for i in range(1, 7)], np.quantile(x, [0, 0.1, 1 / 3, 0.5, 0.99, 1]))


def test_flat_outcome_is_never_a_marginal_hit(spark):
    rows = [("a", i, i * DAY, "c", 1.0) for i in range(10)] + [("a", 10 + i, (10 + i) * DAY, "c", y) for i, y in enumerate([1.0, 0.0, -1.0, 1.0])]
    d = spark.createDataFrame(rows, "symbol string, pos long, t long, cat string, y double")
    f = S.fold_table(d, 10 * DAY, 10 * DAY, 0)
    r = SC.category_marginal(d, f, "y", "cat", 10 * DAY, 10 * DAY).first()
    assert (r.n_train, r.n_test, r.base_rate, r.marginal_acc) == (10, 4, 1.0, 0.5)


def test_word_boundaries(spark):
    texts = ["we go together", "ETH up", "a hackathon", "Hacked again", "éth", "binance coin, sol", "the SEC's bans"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r[0], r[1]) for r in d.select(X.tags(F.col("t"), X.ASSET_ALIASES), X.tags(F.col("t"), X.EVENT_KEYWORDS)).collect()]
    assert got == [([], []), (["ETH"], []), ([], []), ([], ["hack"]), ([], []), (["BNB", "SOL"], []), ([], ["regulation"])]


def test_slug_titles(spark):
    urls = ["https://x.com/a/bitcoin-hits_new-high/", "https://x.com/btc-falls/12345?x=1", "https://x.com/p#top", ""]
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in d.select(X.title_from_url(F.col("u"))).collect()] == ["Bitcoin Hits New High", "Btc Falls", "P", ""]


def test_base_asset_and_vocabulary(spark):
    d = spark.createDataFrame([("BTCUSDT", '{"event_type":"hack"}'), ("ETHUSD", '{"event_type":"weather"}'), ("USDTX", "{oops")], "s string, j string")
    got = [(r[0], r[1]) for r in d.select(X.base_asset(F.col("s")), X.closed_label(F.col("j"))).collect()]
    assert got == [("BTC", "hack"), ("ETH", None), ("USDTX", None)]


def test_null_and_empty_body_stay_apart(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "url int, body string")
    assert [r.url for r in U.pending(d, "body").collect()] == [1]
    up = spark.createDataFrame([(1, ""), (3, None)], "url int, body string")
    assert {r.url: r.body for r in U.keyed_update(d, up, "url", ["body"]).collect()} == {1: "", 2: "", 3: None}


def test_html_body(spark):
    pages = ["<p>a &amp; b</p><script>x='<p>no</p>'</script><nav><p>menu</p></nav><p class=c>c <b>d</b>&#8217;s &#x27;q&#39;</p>", "<div>none</div>", "<p> </p>"]
    d = spark.createDataFrame([(p,) for p in pages], "h string")
    assert [r[0] for r in d.select(H.body_text(F.col("h"))).collect()] == ["a & b\nc d’s 'q'", "", ""]


def test_unescape_is_one_level(spark):
    d = spark.createDataFrame([("&amp;lt; &lt;b&gt; &amp;#39;",)], "h string")
    assert d.select(H.unescape(F.col("h"))).first()[0] == "&lt; <b> &#39;"


def test_epoch_units(spark):
    d = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,), (1_700_000_000_123_456,), (1_700_000_000_123_456_789,)], "x long")
    us = [r[0] for r in d.select(epoch_to_micros(F.col("x"))).collect()]
    assert us == [1_700_000_000_000_000, 1_700_000_000_123_000, 1_700_000_000_123_456, 1_700_000_000_123_456]


def test_feeds_drop_undated_entries(spark):
    xml = """<rss><channel><item><title>a</title><link>u1</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item>
    <item><title>b</title><link>u2</link><pubDate>Mon, 15 Jan 2024 10:00:00 +0300</pubDate></item><item><title>c</title><link>u3</link></item></channel></rss>"""
    d = P.rss_items(spark.createDataFrame([("s", xml)], "source string, payload string"))
    assert {r.url: r.published_at for r in d.collect()} == {"u1": dt.datetime(2024, 1, 15, 10), "u2": dt.datetime(2024, 1, 15, 7)}


def test_articles_count_raw_for_truncation(spark):
    js = '{"articles":[{"url":"u","title":"t","seendate":"20240115T101500Z","domain":"d"},{"url":"","title":"t","seendate":"20240115T101500Z"},{"url":"v","title":"t","seendate":"bad"}]}'
    d = spark.createDataFrame([(js, 0, 8 * HOUR)], "payload string, start_us long, end_us long")
    got = P.article_list(d).collect()
    assert [(r.url, r.source, r.published_at) for r in got] == [("u", "gdelt:d", dt.datetime(2024, 1, 15, 10, 15))]
    assert [(r.start_us, r.end_us) for r in P.windows_to_refetch(d, limit=3).collect()] == [(0, 4 * HOUR), (4 * HOUR, 8 * HOUR)]
    assert P.windows_to_refetch(d, limit=4).count() == 0
    assert P.windows_to_refetch(d.withColumn("end_us", F.lit(HOUR)), limit=3).count() == 0


def test_recency_weight_halves(spark):
    d = spark.createDataFrame([(0,), (5 * DAY,)], "t long")
    w = [r[0] for r in d.select(S.recency_weight(F.col("t"), F.lit(10 * DAY), 5.0)).collect()]
    assert w == pytest.approx([0.25, 0.5])
