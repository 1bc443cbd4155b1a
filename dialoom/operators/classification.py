"""Classifiers: centroids, and the trainable ones of Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.errors import ConfigurationError, ModelError
from dialoom.operators.vectors import cosine


@dataclass(frozen=True)
class LabelSpace:
    labels: tuple[str, ...]
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5

    def __post_init__(self):
        if len(set(self.labels)) != len(self.labels) or not self.labels:
            raise ConfigurationError("labels are there and differ")
        if set(self.thresholds) - set(self.labels):
            raise ConfigurationError("a threshold is of no label")

    def threshold(self, label):
        known = [F.when(label == k, F.lit(float(v))) for k, v in self.thresholds.items()]
        return F.coalesce(*known, F.lit(float(self.default_threshold)))


def _scores(rows: DataFrame, space: LabelSpace) -> DataFrame:
    """rows(source_id, label, score) to one row each with scores best first, ties by label."""
    t = space.threshold(F.col("label"))
    item = F.struct((-F.col("score")).alias("k"), "label", "score", F.col("score").alias("confidence"), t.alias("threshold"), (F.col("score") >= t).alias("is_positive"))
    best = rows.groupBy("source_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    return best.select("source_id", F.transform("all", lambda x: F.struct(*[x[c].alias(c) for c in ("label", "score", "confidence", "threshold", "is_positive")])).alias("scores"))


def centroids_of(labelled: DataFrame, label: str = "label", vec: str = "vector") -> DataFrame:
    parts = labelled.select(F.col(label).cast("string").alias("label"), F.posexplode(vec).alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vector"))


def classify_by_centroid(inputs: DataFrame, centroids: DataFrame, space: LabelSpace) -> DataFrame:
    """(source_id, scores): cosine to each label's centroid, held to 0..1. inputs(source_id, embedding) needs embeddings of the right size."""
    c = centroids.where(F.col("label").isin(*space.labels)).select("label", F.col("vector").alias("centroid"))  # a row per label
    pairs = inputs.join(F.broadcast(c), how="cross")
    fits = F.assert_true(F.coalesce(F.size("embedding") == F.size("centroid"), F.lit(False)), "an embedding is missing or has another size").isNull()
    return _scores(pairs.where(fits).select("source_id", "label", F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("centroid")))).alias("score")), space)


def predictions(results: DataFrame, model: str, source_type: str = "context_window") -> DataFrame:
    """A row for each positive label. Ids hash what they stand for."""
    kind = source_type if source_type in ("turn", "context_window", "conversation") else "context_window"
    rows = results.select("source_id", F.explode(F.filter("scores", lambda s: s["is_positive"])).alias("s")).select("source_id", "s.label", "s.score", "s.confidence", "s.threshold")
    key = F.sha2(F.concat_ws("\x1f", F.col("source_id").cast("string"), "label", F.lit(model)), 256)
    return rows.select(F.concat(F.lit("pred_"), F.substring(key, 1, 16)).alias("prediction_id"), "source_id", F.lit(kind).alias("source_type"), "label", "score", "confidence", "threshold", (F.col("score") >= F.col("threshold")).alias("is_above_threshold"))


def train(kind: str, rows: DataFrame, features: str = "features", label: str = "label", seed: int = 42) -> tuple[list[str], PipelineModel]:
    """A classifier of array features: logistic, boosted trees or a perceptron."""
    data = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("string").alias("name"))
    indexer = StringIndexer(inputCol="name", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    data = indexer.transform(data).cache()
    size, names = data.select(F.size(vector_to_array("x")).alias("n")).first(), list(indexer.labels)
    if kind == "logistic":
        model = LogisticRegression(maxIter=1000, featuresCol="x", labelCol="y")
    elif kind == "boosted_trees":
        tree = GBTClassifier(maxIter=20, maxLeafNodesNum=31, seed=seed, featuresCol="x", labelCol="y") if "maxLeafNodesNum" in GBTClassifier.__init__.__code__.co_varnames else GBTClassifier(maxIter=20, seed=seed, featuresCol="x", labelCol="y")
        model = tree if len(names) == 2 else OneVsRest(classifier=tree, featuresCol="x", labelCol="y")
    elif kind == "perceptron":
        model = MultilayerPerceptronClassifier(maxIter=500, layers=[size.n, 128, 64, max(2, len(names))], seed=seed, featuresCol="x", labelCol="y")
    else:
        raise ModelError(f"no classifier {kind}")
    return names, PipelineModel([model.fit(data)])


def classify_by_model(inputs: DataFrame, trained: tuple[list[str], PipelineModel], space: LabelSpace, features: str = "features") -> DataFrame:
    """(source_id, scores): probabilities of the labels; a label that was never seen has 0."""
    names, model = trained
    out = model.transform(inputs.withColumn("x", array_to_vector(F.col(features).cast("array<double>"))))
    if "probability" not in out.columns:  # one against the rest: raw margins through the logistic function
        out = out.withColumn("p", F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-m))))
    else:
        out = out.withColumn("p", vector_to_array("probability"))
    each = [F.struct(F.lit(n).alias("label"), (F.get("p", F.lit(names.index(n))) if n in names else F.lit(0.0)).alias("score")) for n in space.labels]
    rows = out.select("source_id", F.explode(F.array(*each)).alias("s")).select("source_id", "s.label", F.coalesce("s.score", F.lit(0.0)).alias("score"))
    return _scores(rows, space)


def save_centroids(spark: SparkSession, centroids: DataFrame, space: LabelSpace, path: str) -> None:
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    meta = json.dumps({"labels": space.labels, "thresholds": space.thresholds, "default_threshold": space.default_threshold})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/labels")


def load_centroids(spark: SparkSession, path: str) -> tuple[DataFrame, LabelSpace]:
    meta = json.loads(spark.read.text(f"{path}/labels").first().value)
    return spark.read.parquet(f"{path}/centroids"), LabelSpace(tuple(meta["labels"]), meta["thresholds"], meta["default_threshold"])
