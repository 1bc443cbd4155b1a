"""Exact vector search by cosine, dot product or distance; upserts; pooling."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.errors import ConfigurationError, ModelError
from dialoom.operators.lexical import ranked
from dialoom.operators.nearest import nearest
from dialoom.sources.working import read_text, write_text

METRICS = ("cosine", "l2", "dot_product")
INDEX_TYPES = ("flat", "hnsw", "ivf_flat")


@dataclass(frozen=True)
class VectorConfig:
    """Index types other than flat are accepted and searched exactly."""

    dimensions: int
    metric: str = "cosine"
    index_type: str = "flat"
    train_required: bool = False

    def __post_init__(self):
        if self.dimensions < 1 or self.metric not in METRICS or self.index_type not in INDEX_TYPES:
            raise ConfigurationError("unknown metric or index type, or no dimensions")
        if self.index_type == "ivf_flat" and not self.train_required:
            raise ConfigurationError("ivf_flat needs train_required")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Norms count as 1e-10 at least."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-10)) * F.greatest(norm(b), F.lit(1e-10)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def score(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": lambda: cosine(a, b), "dot_product": lambda: dot(a, b), "l2": lambda: 1 / (1 + distance(a, b))}[metric]()


def l2_normalize(v: Column) -> Column:
    return F.when(norm(v) == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x / norm(v)))


def pool(df: DataFrame, key: str, vec: str, strategy: str = "mean") -> DataFrame:
    """One vector per key: the mean or the maximum of each dimension."""
    if strategy not in ("mean", "max"):
        raise ModelError(f"{strategy} pooling needs a model")
    f = F.avg if strategy == "mean" else F.max
    parts = df.select(key, F.posexplode(vec).alias("dim", "x")).groupBy(key, "dim").agg(f(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vector"))


def upsert(old: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """old with rows of new in place of those with their keys. new(…, seq): of rows with one key the largest seq counts."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("_n = 1").drop("_n", "seq")
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(old.columns))


def search(vectors: DataFrame, queries: DataFrame, config: VectorConfig, top_k: int = 10, id_col: str = "doc_id", vec_col: str = "vector") -> DataFrame:
    """(query_id, rank, doc_id, score) of the top_k for queries(query_id, query_vector).

    A stated set of queries against all vectors. Scoring needs every pair, in blocks (see nearest); ranks are cut within each
    task before the exchange, so it carries top_k rows per query and part of the vectors.
    """
    rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("v"))
    bad = F.size("v") != config.dimensions
    rows = rows.where(F.assert_true(~bad, "a vector has other dimensions than the index").isNull())
    return ranked(nearest(rows, queries.select("query_id", "query_vector"), config.metric, config.dimensions, top_k), "raw", top_k)


def save(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, config: VectorConfig, vec_col: str = "vector") -> DataFrame:
    vectors = spark.read.parquet(path)
    if vectors.where(F.size(vec_col) != config.dimensions).limit(1).count():
        raise ModelError(f"{path}: vectors have other dimensions than {config.dimensions}")
    return vectors


class VectorStore:
    """A collection of vectors(source_id, vector, …) under a path: upsert, search, clear, count and stats.

    Each change writes a table of its own and then names it in `current`, so readers never see half a change. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, config: VectorConfig):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    def rows(self) -> DataFrame | None:
        at = read_text(self.spark, f"{self.path}/current")
        return None if not at else load(self.spark, f"{self.path}/{at}", self.config)

    def _keep(self, table: DataFrame | None) -> None:
        at = "" if table is None else f"v{time.time_ns()}"
        if table is not None:
            save(table, f"{self.path}/{at}")
        write_text(self.spark, f"{self.path}/current", at)

    def upsert(self, rows: DataFrame) -> None:
        """rows(source_id, vector, …, seq): of rows with one key the largest seq counts."""
        old = self.rows()
        columns = rows.drop("seq").columns
        self._keep(upsert(rows.select(columns).limit(0) if old is None else old.select(columns), rows))

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame | None:
        rows = self.rows()
        return None if rows is None else search(rows, queries, self.config, top_k, "source_id")

    def clear(self) -> None:
        self._keep(None)

    def count(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()

    def stats(self) -> dict:
        return {"vectors": self.count(), "dimensions": self.config.dimensions, "metric": self.config.metric, "index_type": self.config.index_type}
