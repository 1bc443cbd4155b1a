"""Transcripts to windows, vectors, indexes, predictions, rule matches and events, as lazy tables."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.errors import ConfigurationError
from dialoom.functions import text as T
from dialoom.operators import analytics, classification, embeddings, lexical, segmentation, windows
from dialoom.plans import rules as R
from dialoom.sources.working import write_text

VERSION = "0.1.0"
STAGES = ("text", "embedding", "index", "classification", "rules", "analytics")


@dataclass(frozen=True)
class PipelineConfig:
    segmentation: segmentation.SegmentationConfig = field(default_factory=segmentation.SegmentationConfig)
    windows: windows.WindowConfig = field(default_factory=windows.WindowConfig)
    embedding_dimensions: int | None = None
    lexical_index: bool = True
    run_ts: str = "1970-01-01 00:00:00"

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def save(self, path: str) -> None:
        with open(path, "w") as out:
            json.dump(asdict(self), out, indent=2)

    @classmethod
    def load(cls, path: str) -> PipelineConfig:
        with open(path) as source:
            data = json.load(source)
        try:
            return cls(segmentation.SegmentationConfig(**data.pop("segmentation", {})), windows.WindowConfig(**data.pop("windows", {})), **data)
        except TypeError as e:
            raise ConfigurationError(str(e)) from e


@dataclass
class PipelineResult:
    turns: DataFrame
    windows: DataFrame
    coverage: DataFrame
    embeddings: DataFrame | None
    index: lexical.LexicalIndex | None
    predictions: DataFrame | None
    rules: DataFrame | None
    events: DataFrame | None
    manifest: dict

    def warnings(self) -> DataFrame:
        return self.coverage.where("orphans > 0").select("conversation_id", F.lit("ORPHAN_TURNS_DETECTED").alias("code"))

    def save(self, path: str) -> None:
        for name in ("turns", "windows", "coverage", "embeddings", "predictions", "rules", "events"):
            if (table := getattr(self, name)) is not None:
                table.write.mode("overwrite").parquet(f"{path}/{name}")


def run(transcripts: DataFrame, config: PipelineConfig = PipelineConfig(), rules: list[R.Rule] = (), centroids: DataFrame | None = None, labels: classification.LabelSpace | None = None) -> PipelineResult:
    """All stages over all conversations; a stage without its component is left out."""
    turns = segmentation.segment(transcripts, config.segmentation)
    spoken = turns.select("conversation_id", F.col("idx").alias("ord"), "speaker", F.coalesce("normalized_text", "raw_text").alias("text"))
    built = windows.build(spoken, config.windows)
    ts: Column = F.lit(config.run_ts).cast("timestamp")
    vectors = predictions = matches = index = None
    if config.embedding_dimensions:
        vectors = built.select(F.col("window_id").alias("source_id"), embeddings.null_embedding(config.embedding_dimensions)("window_text").alias("vector"))
    if config.lexical_index:
        index = lexical.index(built, "window_id", "window_text")
    if centroids is not None and labels is not None and vectors is not None:
        results = classification.classify_by_centroid(vectors.withColumnRenamed("vector", "embedding"), centroids, labels)
        predictions = classification.predictions(results, "centroid")
    if rules:
        features = T.lexical_features(F.col("window_text"))
        pairs = [x for name, c in features.items() for x in (F.lit(name), c)]
        inputs = built.select(F.col("window_id").alias("source_id"), "conversation_id", F.col("window_text").alias("text"), F.create_map(*pairs).alias("features"), F.create_map(F.lit("total_chars"), F.char_length("window_text").cast("string")).alias("metadata"))
        matches = R.executions(R.evaluate(inputs, list(rules)))
    parts = [analytics.events_of_predictions(predictions, ts)] if predictions is not None else []
    parts += [analytics.events_of_rules(matches, ts)] if matches is not None else []
    events = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None
    manifest = {"fingerprint": config.fingerprint, "stages": [n for n, x in (("text", turns), ("embedding", vectors), ("index", index), ("classification", predictions), ("rules", matches), ("analytics", events)) if x is not None]}
    return PipelineResult(turns, built, windows.coverage(spoken, built), vectors, index, predictions, matches, events, manifest)


def summary(result: PipelineResult) -> DataFrame:
    out = result.turns.agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conversation_id").alias("conversations"))
    return out.join(result.windows.agg(F.count(F.lit(1)).alias("windows")))


def counts(result: PipelineResult) -> dict[str, int]:
    """Rows of each table of a run; 0 for a stage that was left out."""
    n = {f"{name}_count": 0 if table is None else table.count() for name, table in (("turns", result.turns), ("windows", result.windows), ("embeddings", result.embeddings), ("predictions", result.predictions), ("rule_executions", result.rules), ("events", result.events))}
    executed = result.manifest["stages"]
    return n | {"stages_executed": len(executed), "stages_skipped": len(STAGES) - len(executed)}


def save_outputs(spark: SparkSession, result: PipelineResult, base: str, input_path: str = "", run_id: str | None = None, tables: bool = True) -> str:
    """base/run_…/ with manifest.json, summary.json and the tables of a run; the folder's path. Tables are written first, and counted as written."""
    run_id = run_id or f"run_{uuid.uuid4().hex[:12]}"
    at, start = f"{base.rstrip('/')}/{run_id}", time.monotonic()
    done = result
    if tables:
        result.save(at)
        read = lambda name: None if getattr(result, name) is None else spark.read.parquet(f"{at}/{name}")
        done = replace(result, **{name: read(name) for name in ("turns", "windows", "embeddings", "predictions", "rules", "events")})
    summary_ = {"run_id": run_id, "input_path": input_path} | counts(done) | {"total_ms": round((time.monotonic() - start) * 1000, 2)}
    write_text(spark, f"{at}/manifest.json", json.dumps({"run_id": run_id, "versions": {"library": VERSION, "spark": spark.version}} | result.manifest, indent=2))
    write_text(spark, f"{at}/summary.json", json.dumps(summary_, indent=2))
    return at


def session(app: str = "dialoom") -> SparkSession:
    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").getOrCreate()
