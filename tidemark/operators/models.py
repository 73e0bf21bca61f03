"""Feature-set registry and multi-horizon models."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import features as X, funding as FU, news as N, orderflow as O
from tidemark.tables import HOUR


def _funding(bars: DataFrame, src: Mapping[str, DataFrame]):
    return FU.attach_funding(bars, src["funding"]), ["f_rate", "f_z", "f_absz"]


def _micro(bars: DataFrame, src: Mapping[str, DataFrame]):
    m = X.microstructure(bars).select("symbol", "t", *X.MICRO)
    return bars.join(m, ["symbol", "t"], "left"), list(X.MICRO)


def _ofi(bars: DataFrame, src: Mapping[str, DataFrame]):
    f = X.ofi_features(O.ofi_bars(src["trades"])).select("symbol", "t", *X.OFI)
    return bars.join(f, ["symbol", "t"], "left"), list(X.OFI)


def _news(bars: DataFrame, src: Mapping[str, DataFrame]):
    kinds: dict[str, Column] = {k: F.array_contains("kinds", k) for k in ("hack", "regulation")}
    f = N.decay_features(src["news"], bars, ["symbol"], HOUR, kinds)
    flags = [c for c in f.columns if c.startswith("event_")]
    f = f.withColumns({c: F.col(c).cast("double") for c in flags})
    return bars.join(f, ["symbol", "t"], "left"), [*N.DECAY_FEATURES, *flags]


# Named feature sets: (bars, source tables) -> (bars with columns, their names).
FEATURE_SETS: dict[str, Callable[[DataFrame, Mapping[str, DataFrame]], tuple[DataFrame, list[str]]]] = {
    "funding": _funding,
    "micro": _micro,
    "ofi": _ofi,
    "news": _news,
}


# --- multi-horizon models --------------------------------------------------------------------------
# Tree settings of the point and quantile models.
POINT = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 5, "minInstancesPerNode": 100, "seed": 42}
QUANTILE = {"trees": 300, "rate": 0.05, "depth": 5, "min_rows": 100, "seed": 42}


def with_vector(df: DataFrame, names: list[str], out: str = "vec") -> DataFrame:
    """Feature vector in which a NULL becomes 0 plus a 1 in its indicator slot.

    Trees can then send missing values either way at any split; rows in the warm-up stay usable.
    """
    from pyspark.ml.feature import VectorAssembler

    cols = {f"_v{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(names)}
    gaps = {f"_g{i}": F.col(c).isNull().cast("double") for i, c in enumerate(names)}
    d = df.withColumns({**cols, **gaps})
    parts = [*cols, *gaps]
    return VectorAssembler(inputCols=parts, outputCol=out).transform(d).drop(*parts)


class PointModel:
    """A boosted model of a target in units of its train mean absolute value.

    Spark's absolute loss fits trees to residual *signs*, so a step only makes sense for a target of
    unit size; predictions are scaled back.
    """

    def __init__(self, model, scale: float, out: str):
        self.model, self.scale, self.out = model, scale, out

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.setPredictionCol(self.out).transform(df).withColumn(self.out, F.col(self.out) * self.scale)


def fit_horizons(train: DataFrame, horizons, vec: str = "vec", weight: str | None = None, **params) -> dict[int, PointModel]:
    """One L1-loss boosted model per horizon; rows without that horizon's target are left out."""
    from pyspark.ml.regression import GBTRegressor

    models = {}
    sizes = train.agg(*[F.avg(F.abs(f"r_{h}")).alias(f"r_{h}") for h in horizons]).first()
    for h in horizons:
        scale = float(sizes[f"r_{h}"] or 1.0)
        gbt = GBTRegressor(featuresCol=vec, labelCol="_label", lossType="absolute", **{**POINT, **params})
        if weight:
            gbt = gbt.setWeightCol(weight)
        rows = train.filter(F.col(f"r_{h}").isNotNull()).withColumn("_label", F.col(f"r_{h}") / scale)
        models[h] = PointModel(gbt.fit(rows), scale, f"r_{h}_pred")
    return models


def predict_horizons(models: Mapping[int, PointModel], df: DataFrame) -> DataFrame:
    for m in models.values():
        df = m.transform(df)
    return df


def prefix_predictions(point: PointModel, df: DataFrame, steps, out: str) -> DataFrame:
    """Predictions of the first k trees for every k in ``steps``, from one fit."""
    raw = []
    for i, t in enumerate(point.model.trees[: max(steps)]):
        raw.append(f"_t{i}")
        df = t.setPredictionCol(raw[-1]).transform(df)
    w = [x * point.scale for x in point.model.treeWeights]
    cols = {f"{out}_{k}": sum((F.col(c) * w[i] for i, c in enumerate(raw[:k])), F.lit(0.0)) for k in steps}
    return df.withColumns(cols).drop(*raw)


class QuantileTrees:
    """Boosted trees for one quantile: a start value plus scaled leaf values per tree."""

    def __init__(self, start: float, rate: float):
        self.start, self.rate, self.trees = start, rate, []

    def step(self, df: DataFrame, tree, leaves: Mapping[float, float], out: str) -> DataFrame:
        leaf = "_leaf"
        d = tree.setLeafCol(leaf).setPredictionCol("_p").transform(df)
        pairs = [F.lit(x) for kv in sorted(leaves.items()) for x in kv]
        add = F.coalesce(F.element_at(F.create_map(*pairs), F.col(leaf)), F.lit(0.0))
        return d.withColumn(out, F.col(out) + F.lit(self.rate) * add).drop(leaf, "_p")

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        d = df.withColumn(out, F.lit(self.start))
        for tree, leaves in self.trees:
            d = self.step(d, tree, leaves, out)
        return d


def fit_quantile(train: DataFrame, target: str, q: float, vec: str = "vec", **params) -> QuantileTrees:
    """Gradient boosting of the pinball loss on Spark trees.

    Each round fits a regression tree to the loss gradient (q above the current forecast, q - 1 below)
    and gives every leaf the q-quantile of its residuals. Leaf values are at most 2^depth numbers; they
    are the only thing that visits the driver. The forecast column is written each round, so the plan
    does not grow with the trees.
    """
    from pyspark.ml.regression import DecisionTreeRegressor

    from tidemark.session import settle

    p = {**QUANTILE, **params}
    d = train.filter(F.col(target).isNotNull()).select(vec, F.col(target).alias("y"))
    start = d.agg(F.percentile_approx("y", q, 10_000)).first()[0]
    model = QuantileTrees(float(start), p["rate"])
    d = settle(d.withColumn("f", F.lit(model.start)))
    for _ in range(p["trees"]):
        g = d.withColumn("g", F.when(F.col("y") > F.col("f"), F.lit(q)).otherwise(F.lit(q - 1.0)))
        tree = DecisionTreeRegressor(
            featuresCol=vec, labelCol="g", leafCol="_leaf", predictionCol="_p", maxDepth=p["depth"],
            minInstancesPerNode=p["min_rows"], seed=p["seed"],
        ).fit(g)
        lv = tree.transform(g).groupBy("_leaf").agg(F.percentile_approx(F.col("y") - F.col("f"), q, 10_000).alias("v"))
        leaves = {float(r["_leaf"]): float(r["v"]) for r in lv.collect()}
        model.trees.append((tree, leaves))
        d = settle(model.step(d, tree, leaves, "f"))
    return model


def importances(point: PointModel, names: list[str], **labels) -> list[dict]:
    """Gain shares per feature, a feature's indicator slot counted with it."""
    v = point.model.featureImportances.toArray()
    n = len(names)
    return [{**labels, "feature": f, "gain": float(v[i] + v[n + i])} for i, f in enumerate(names)]


def importance_table(spark, rows: list[dict]) -> DataFrame:
    """Percent of the total gain per feature, averaged over models."""
    from pyspark.sql import Window as W

    d = spark.createDataFrame(rows)
    keys = [c for c in d.columns if c not in ("feature", "gain")]
    total = F.sum("gain").over(W.partitionBy(*keys))
    d = d.withColumn("pct", F.when(total > 0, F.col("gain") / total * 100).otherwise(0.0))
    return d.groupBy("feature").agg(F.avg("pct").alias("mean_gain_pct"), F.count(F.lit(1)).alias("n_models"))


def walk_forward(
    data: DataFrame, folds: list, variants: Mapping[str, list[str]], horizons, path: str, weight=None, workers: int = 4, **params
) -> DataFrame:
    """Fit and score every (symbol, fold, variant) and return long predictions.

    ``data`` carries ``pos`` and one vector column per variant; ``folds`` are the fold table's rows (a
    few per symbol). Every task writes its own folder, and folders that exist are not done again, so
    an interrupted run goes on where it stopped. ``weight(fold)`` gives an optional weight column.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = data.sparkSession
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def run(task):
        f, variant = task
        out = f"{path}/symbol={f['symbol']}/fold={f['fold']}/variant={variant}"
        if fs.exists(jvm.org.apache.hadoop.fs.Path(out + "/_SUCCESS")):
            return
        mine = data.filter(F.col("symbol") == f["symbol"])
        train = mine.filter((F.col("pos") >= f["train_pos"]) & (F.col("pos") < f["train_end_pos"]))
        test = mine.filter((F.col("pos") >= f["test_pos"]) & (F.col("pos") < f["test_pos"] + f["n_test"]))
        w = None
        if weight is not None:
            w, train = "_w", train.withColumn("_w", weight(f))
        models = fit_horizons(train, horizons, variant, w, **params)
        rows = F.explode(
            F.array(
                *[
                    F.struct(F.lit(h).alias("horizon"), F.col(f"r_{h}").alias("actual"), F.col(f"r_{h}_pred").alias("predicted"))
                    for h in horizons
                ]
            )
        )
        predict_horizons(models, test).select("t", rows.alias("r")).select("t", "r.*").write.mode("overwrite").parquet(out)

    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(run, [(f, v) for f in folds for v in variants]))
    return spark.read.parquet(path)


def prediction_metrics(preds: DataFrame, groups=("symbol", "fold", "variant", "horizon")) -> DataFrame:
    from tidemark.functions import metrics as M

    a, p = F.col("actual"), F.col("predicted")
    return preds.groupBy(*groups).agg(
        M.mae(a, p).alias("mae"), M.directional_accuracy(a, p).alias("directional_accuracy"), M.n_pairs(a, p).alias("n_test")
    )


def export_models(models: Mapping, path: str, symbol: str, names: list[str], version: str, n_rows: int, baseline: DataFrame | None = None) -> DataFrame:
    """Save final models under the shared folder and return their metadata row.

    The schema version is the hash of the feature list; ``baseline`` is a drift table to keep with it.
    """
    from tidemark.functions.text import schema_version

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for h, m in models.items():
        m.model.write().overwrite().save(f"{path}/{symbol}/h{h}")
    scales = {str(h): m.scale for h, m in models.items()}
    row = spark.createDataFrame(
        [(symbol, version, list(names), sorted(models), scales, n_rows)],
        "symbol string, model_version string, feature_columns array<string>, horizons array<int>, target_scale map<string,double>, n_rows long",
    )
    row = row.withColumn("schema_version", schema_version(F.col("feature_columns")))
    if baseline is not None:
        b = baseline.groupBy("symbol").agg(F.collect_list(F.struct("feature", "mean", "std", "bin_edges", "bin_fractions")).alias("feature_baseline"))
        row = row.join(b, "symbol", "left")
    return row
