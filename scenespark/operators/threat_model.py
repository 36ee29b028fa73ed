"""Random-forest threat labels on the same features, with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.functions.scores import threat_label


@dataclass
class ThreatModel:
    """A fitted classifier, or the one label all training rows had."""

    pipeline: PipelineModel | None
    labels: list[str]
    n_samples: int
    accuracy: float | None = None
    cv_accuracy: float | None = None


def training_rows(features: DataFrame, model_scores: DataFrame) -> DataFrame:
    """Features with the label derived from the anomaly model's score."""
    return features.join(model_scores, ["feed_id", "frame_id"]).withColumn("label_text", threat_label("model_score"))


def _stages(trees: int, depth: int, seed: int) -> Pipeline:
    return Pipeline(stages=[
        StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=C.FEATURES, outputCol="vector"),
        RandomForestClassifier(
            featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed,
            featureSubsetStrategy="sqrt",
        ),
    ])


def fit(
    rows: DataFrame, trees: int = 200, depth: int = 10, seed: int = C.SEED, folds: int = 5
) -> ThreatModel:
    """Train on labelled rows; ``folds`` 0 skips cross-validation."""
    counts = {r["label_text"]: r["count"] for r in rows.groupBy("label_text").count().collect()}
    labels, n = sorted(counts), sum(counts.values())
    if n == 0:
        return ThreatModel(None, [], 0)
    if len(labels) == 1:
        return ThreatModel(None, labels, n, accuracy=1.0)
    rows = rows.persist()
    try:
        model = _stages(trees, depth, seed).fit(rows)
        judge = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
        accuracy = round(float(judge.evaluate(model.transform(rows))), 4)
        cv = None
        # rare labels may be missing from a fold; only if all are rare there is nothing to judge
        if folds and n >= 10 and max(counts.values()) >= folds:
            indexed = model.stages[1].transform(model.stages[0].transform(rows))
            forest = RandomForestClassifier(
                featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed,
                featureSubsetStrategy="sqrt",
            )
            fitted = CrossValidator(
                estimator=forest, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge,
                numFolds=folds, seed=seed,
            ).fit(indexed)
            cv = round(float(fitted.avgMetrics[0]), 4)
        return ThreatModel(model, labels, n, accuracy, cv)
    finally:
        rows.unpersist()


def classify(features: DataFrame, model: ThreatModel | None) -> DataFrame:
    """``threat_label`` and ``threat_proba`` (label -> share, 4 decimals)."""
    empty = F.create_map().cast("map<string,double>")
    if model is None or not model.labels:
        return features.withColumn("threat_label", F.lit("UNKNOWN")).withColumn("threat_proba", empty)
    if model.pipeline is None:
        only = F.lit(model.labels[0])
        return features.withColumn("threat_label", only).withColumn("threat_proba", F.create_map(only, F.lit(1.0)))
    labels = model.pipeline.stages[0].labels
    assembled = model.pipeline.stages[1].transform(features)
    scored = model.pipeline.stages[2].transform(assembled)
    share = vector_to_array("probability")
    return (
        scored.withColumn("threat_label", F.get(F.lit(labels), F.col("prediction").cast("int")))
        .withColumn("threat_proba", F.map_from_arrays(
            F.lit(labels), F.transform(share, lambda p: exact_round(p, 4))))
        .drop("vector", "rawPrediction", "probability", "prediction")
    )


def save(model: ThreatModel, path: str, spark: SparkSession) -> None:
    meta = [(model.labels, model.n_samples, model.accuracy, model.cv_accuracy, model.pipeline is not None)]
    schema = "labels array<string>, n_samples long, accuracy double, cv_accuracy double, has_trees boolean"
    if model.pipeline is not None:
        model.pipeline.write().overwrite().save(f"{path}/trees")
    spark.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> ThreatModel:
    schema = "labels array<string>, n_samples long, accuracy double, cv_accuracy double, has_trees boolean"
    m = spark.read.schema(schema).json(f"{path}/meta").head()
    trees = PipelineModel.load(f"{path}/trees") if m["has_trees"] else None
    return ThreatModel(trees, list(m["labels"]), m["n_samples"], m["accuracy"], m["cv_accuracy"])
