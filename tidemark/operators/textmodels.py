"""Text scoring on Spark ML: sentiment, event type, supervised quality model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.dedup import tokens


def fit_text_classifier(rows: DataFrame, text: str, label: str, buckets: int = 4096, iters: int = 20) -> tuple[PipelineModel, list[str]]:
    """Multinomial logistic regression on hashed word counts of the whole text."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=buckets)
    lr = LogisticRegression(featuresCol="_tf", labelCol="_y", probabilityCol="_prob", predictionCol="_pred",
                            rawPredictionCol="_raw", maxIter=iters, regParam=0.01, family="multinomial")
    back = IndexToString(inputCol="_pred", outputCol="predicted", labels=index.labels)
    d = rows.withColumn("_tok", tokens(F.col(text), ()))
    model = Pipeline(stages=[index, tf, lr]).fit(d)
    return PipelineModel(stages=[*model.stages[1:], back]), index.labels


def score(model: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """``predicted`` label, class probabilities ``probs`` (in label order) and their top value."""
    d = model.transform(rows.withColumn("_tok", tokens(F.col(text), ())))
    d = d.withColumn("probs", vector_to_array("_prob"))
    return d.withColumn("confidence", F.array_max("probs")).drop("_tok", "_tf", "_raw", "_prob", "_pred")


def sentiment(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Named probabilities; a class the model does not know scores 0."""
    def p(name):
        return F.col("probs")[labels.index(name)] if name in labels else F.lit(0.0)

    return rows.withColumns(
        {
            "sentiment_pos": p("positive"), "sentiment_neu": p("neutral"), "sentiment_neg": p("negative"),
            "sentiment_confidence": F.col("confidence"),
        }
    )


def newest_share(rows: DataFrame, order: str, share: float = 0.1) -> DataFrame:
    """``part`` = 'val' for the newest share of the rows (at least one), else 'train'; never shuffled.

    The cut is the exact order statistic; rows are not numbered in one task. ``order`` is unique.
    """
    from tidemark.operators.ranks import ordered_counts

    n = rows.count()
    ranks = ordered_counts(rows.select(order, F.lit(0).alias("_all")), ["_all"], order)
    cut = ranks.filter(F.col("below") >= n - max(1, int(n * share))).agg(F.min(order)).first()[0]
    return rows.withColumn("part", F.when(F.col(order) >= F.lit(cut), "val").otherwise("train"))


def class_report(scored: DataFrame, label: str) -> DataFrame:
    """Per class precision, recall and F1, with overall accuracy and macro F1 on every row."""
    pairs = F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(0).alias("side")), F.struct(F.col("predicted").alias("c"), F.lit(1).alias("side"))))
    hit = (F.col(label) == F.col("predicted")).cast("int").alias("hit")
    g = scored.select(hit, pairs.alias("x")).groupBy(F.col("x.c").alias("label")).agg(
        F.count(F.when(F.col("x.side") == 0, 1)).alias("n_true"), F.count(F.when(F.col("x.side") == 1, 1)).alias("n_pred"),
        F.sum(F.when(F.col("x.side") == 0, F.col("hit"))).alias("tp"),
    )
    zero = F.lit(0.0)
    g = g.fillna(0, ["tp"]).withColumns(
        {"precision": F.coalesce(F.col("tp") / F.nullif(F.col("n_pred"), F.lit(0)), zero), "recall": F.coalesce(F.col("tp") / F.nullif(F.col("n_true"), F.lit(0)), zero)}
    )
    both = F.col("precision") + F.col("recall")
    g = g.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(zero))
    w = W.partitionBy(F.lit(1))  # a handful of classes
    return g.withColumns({"macro_f1": F.avg("f1").over(w), "accuracy": F.sum("tp").over(w) / F.sum("n_true").over(w)})
