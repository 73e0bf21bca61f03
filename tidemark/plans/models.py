"""Queries that fit models. They have no SQL twin; tests check them on planted signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import tables as T
from tidemark.functions import text as X
from tidemark.operators import evaluation as E, features as FE, models as MO, screens as SC, splits as S, targets as Y, textmodels as TM
from tidemark.operators import upserts as U
from tidemark.plans import evaluation as PE, joins as PJ
from tidemark.plans.news import news_table
from tidemark.plans.registry import query
from tidemark.session import fresh_dir, settle

# Small models: the queries show the mechanics over all symbols and folds.
TINY = {"maxIter": 3, "maxDepth": 3, "minInstancesPerNode": 20, "stepSize": 0.1}
TECH = ["ret_lag_1", "ret_lag_2", "ret_mean_6", "ret_std_36", "vol_mean_12", "rsi", "macd_diff", "bb_width", "hour_sin", "hour_cos"]
HZ = [1, 6]


def model_data(spark, sf, variants):
    """Dataset with one vector column per variant, computed once."""
    bars = T.bars(spark, sf)
    d = Y.dataset(bars, horizons=[1, 6, 12])
    names = [n for v in variants.values() for n in v]
    if any(n in FE.MICRO for n in names):
        d = d.join(FE.microstructure(bars).select("symbol", "t", *FE.MICRO), ["symbol", "t"])
    for v, cols in variants.items():
        d = MO.with_vector(d, cols, v)
    d = settle(d.select("symbol", "t", "pos", "ret_std_144", "r_1", "r_6", "r_12", *variants))
    return d, S.fold_table(d, PE.MIN_TRAIN, PE.TEST, PE.PURGE)


@query("walkforward_gbt")
def walkforward_gbt(spark, sf):
    """Purged walk-forward of boosted point models, per symbol, fold and horizon."""
    v = {"technical": TECH}
    d, folds = model_data(spark, sf, v)
    preds = MO.walk_forward(d, folds.collect(), v, HZ, fresh_dir(spark, "walkforward"), **TINY)
    return MO.prediction_metrics(preds)


@query("variant_experiment")
def variant_experiment(spark, sf):
    """Two feature sets on the same folds, pooled side by side with their differences."""
    v = {"technical": TECH, "with_micro": TECH + FE.MICRO}
    d, folds = model_data(spark, sf, v)
    preds = MO.walk_forward(d, folds.collect(), v, [6], fresh_dir(spark, "variants"), **TINY)
    ms = ["mae", "directional_accuracy"]
    pooled = E.pool(MO.prediction_metrics(preds), ms, ["symbol", "variant", "horizon"])
    return E.side_by_side(pooled, ["symbol", "horizon"], ms, "technical", "with_micro")


@query("recency_experiment")
def recency_experiment(spark, sf):
    """Recency weights with two half-lives and a sliding window against the expanding window."""
    v = {"technical": TECH}
    d, folds = model_data(spark, sf, v)
    short = S.fold_table(d, PE.MIN_TRAIN, PE.TEST, PE.PURGE, 8 * T.DAY)
    runs = {
        "expanding": (folds, None),
        "half_life_5": (folds, lambda f: S.recency_weight(F.col("t"), F.lit(f["test_start"]), 5.0)),
        "window_8d": (short, None),
    }
    out = None
    for name, (ft, weight) in runs.items():
        p = MO.walk_forward(d, ft.collect(), v, [6], fresh_dir(spark, "recency"), weight=weight, **TINY)
        m = MO.prediction_metrics(p).withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return E.pool(out, ["mae", "directional_accuracy"], ["variant"])


@query("vol_scaled_experiment")
def vol_scaled_experiment(spark, sf):
    """Target divided by trailing deviation, prediction multiplied back, against the raw target."""
    v = {"technical": TECH}
    d, folds = model_data(spark, sf, v)
    ft = folds.collect()
    raw = MO.walk_forward(d, ft, v, [6], fresh_dir(spark, "raw"), **TINY).withColumn("variant", F.lit("raw"))
    sd = F.col("ret_std_144")
    scaled = settle(d.withColumn("r_6", Y.vol_scaled(F.col("r_6"), sd)))
    p = MO.walk_forward(scaled, ft, v, [6], fresh_dir(spark, "scaled"), **TINY)
    back = p.join(d.select("symbol", "t", "r_6", "ret_std_144"), ["symbol", "t"]).withColumns(
        {"predicted": Y.vol_unscaled(F.col("predicted"), sd), "actual": F.col("r_6"), "variant": F.lit("scaled")}
    )
    both = raw.unionByName(back.select(raw.columns))
    pooled = E.pool(MO.prediction_metrics(both), ["mae", "directional_accuracy"], ["symbol", "variant"])
    return E.versus_level(pooled, ["symbol"], "variant", "raw", "mae")


@query("tree_prefixes")
def tree_prefixes(spark, sf):
    """One fit per horizon on the whole train part, scored on the holdout at several tree counts."""
    from tidemark.functions import metrics as M

    d, _ = model_data(spark, sf, {"technical": TECH})
    d = S.holdout(d, 7.0)
    out = None
    for h, m in MO.fit_horizons(d.filter("part = 'train'"), HZ, "technical", **{**TINY, "maxIter": 6}).items():
        steps = (2, 4, 6)
        p = MO.prefix_predictions(m, d.filter("part = 'holdout'"), steps, "k")
        cells = [
            ({"horizon": h, "n_trees": k}, {"mae": M.mae(F.col(f"r_{h}"), F.col(f"k_{k}")), "n": M.n_pairs(F.col(f"r_{h}"), F.col(f"k_{k}"))})
            for k in steps
        ]
        r = E.stacked(p, ["symbol"], cells)
        out = r if out is None else out.unionByName(r)
    return out


@query("feature_importance")
def feature_importance(spark, sf):
    """Mean share of the split gain per feature over the horizons' models."""
    d, _ = model_data(spark, sf, {"technical": TECH})
    rows = []
    for h, m in MO.fit_horizons(d, HZ, "technical", **TINY).items():
        rows += MO.importances(m, TECH, horizon=h)
    return MO.importance_table(spark, rows)


@query("quantile_corridor")
def quantile_corridor(spark, sf):
    """Boosted quantile models fitted on the train part, loss and coverage on the holdout."""
    from tidemark.functions import metrics as M

    d, _ = model_data(spark, sf, {"technical": TECH})
    d = S.holdout(d, 7.0)
    test = d.filter("part = 'holdout'")
    cells = []
    for q in (0.1, 0.9):
        m = MO.fit_quantile(d.filter("part = 'train'"), "r_6", q, "technical", trees=4, rate=0.3, depth=3, min_rows=20)
        test = m.predict(test, f"q_{int(q * 100)}")
        a, p = F.col("r_6"), F.col(f"q_{int(q * 100)}")
        cells.append(({"horizon": 6, "quantile": q}, {"pinball_loss": M.pinball(a, p, q), "coverage": M.coverage(a, p), "n": M.n_pairs(a, p)}))
    return E.stacked(test, ["symbol"], cells)


@query("final_export")
def final_export(spark, sf):
    """Final fit on everything, saved under the shared folder, with its metadata row and drift baseline."""
    d, _ = model_data(spark, sf, {"technical": TECH})
    n = d.count()
    models = MO.fit_horizons(d, HZ, "technical", **TINY)
    base = SC.drift_baseline(d.select(F.lit("all").alias("symbol"), "ret_std_144"), ["ret_std_144"])
    return MO.export_models(models, fresh_dir(spark, "models"), "all", TECH, "v1", n, base)


# --- text ---------------------------------------------------------------------------------------------
@query("text_sentiment")
def text_sentiment(spark, sf):
    """Pending items scored by a model trained on market labels: three probabilities and the top one."""
    items = PJ.news_items(spark, sf)
    lab = Y.label_news(items.select("url", "symbol", "t", "title"), T.bars(spark, sf))
    pending = settle(U.pending(news_table(spark, sf), "sentiment_pos").select("url", "title"))
    # A scored item never teaches its own future.
    train = settle(lab.join(pending.select("url"), "url", "left_anti").select("title", "label"))
    model, labels = TM.fit_text_classifier(train, "title", "label")
    s = TM.sentiment(TM.score(model, pending, "title"), labels)
    return s.select("url", "sentiment_pos", "sentiment_neu", "sentiment_neg", "sentiment_confidence")


@query("text_event_type")
def text_event_type(spark, sf):
    """Event type of the items that have none, from a model of those that do; closed vocabulary."""
    items = PJ.news_items(spark, sf)
    known = settle(items.filter("llm_event_type is not null").select("title", "llm_event_type"))
    model, _ = TM.fit_text_classifier(known, "title", "llm_event_type", iters=5)
    s = TM.score(model, items.filter("llm_event_type is null").select("url", "title"), "title")
    return s.select("url", F.when(F.col("predicted").isin(*X.EVENT_TYPES), F.col("predicted")).alias("event_type"), "confidence")


@query("text_classifier")
def text_classifier(spark, sf):
    """Quality classes of labelled documents, trained on the older 90 percent, judged on the newest."""
    d = T.read(spark, sf, "documents").join(T.read(spark, sf, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    d = settle(TM.newest_share(settle(d), "doc_id"))
    model, _ = TM.fit_text_classifier(d.filter("part = 'train'"), "text", "label")
    return TM.class_report(TM.score(model, d.filter("part = 'val'"), "text"), "label")
