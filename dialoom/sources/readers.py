"""Readers of transcripts, corpora and archives; writers of reports."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.sources.working import write_text


def transcripts(spark: SparkSession, path: str, channel: str = "voice", source_format: str = "labeled") -> DataFrame:
    """One transcript per text file; its id is conv_ and the file's name without ending."""
    rows = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    none = "array<struct<speaker_label: string, role: string>>"
    return rows.select(F.concat(F.lit("conv_"), stem).alias("conversation_id"), F.lit(channel).alias("channel"), F.lit(source_format).alias("source_format"), F.col("value").alias("raw_text"), F.lit(None).cast(none).alias("speaker_hints"))


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A corpus of one JSON object per line; blank lines are passed over."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def zipped_json(spark: SparkSession, path: str, min_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conversations, counts by reason) of archives of JSON files; one archive is opened by one task, a file at a time."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.startswith("__MACOSX") or not name.endswith(".json"):
                            continue
                        try:
                            data = json.loads(z.read(name))
                            text = data.get("text") or data.get("transcript") or ""
                            reason = "empty" if not text.strip() else "short" if len(text.split()) < min_words else "ok"
                        except (ValueError, AttributeError):
                            text, reason = "", "bad json"
                        yield pd.DataFrame({"source": [source], "conversation_id": [PurePosixPath(name).stem], "text": [text], "reason": [reason]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "source string, conversation_id string, text string, reason string")
    return rows.where("reason = 'ok'").drop("reason"), rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def chat_dataset(df: DataFrame, min_words: int = 10, seconds_per_turn: int = 15) -> DataFrame:
    """Rows with messages (array of role and content) as transcripts of `[role] content` lines."""
    lines = F.transform("messages", lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["content"]))
    out = df.withColumn("raw_text", F.array_join(lines, "\n")).withColumn("duration_seconds", F.size("messages") * seconds_per_turn)
    return out.where(F.size(F.filter(F.split("raw_text", r"\s+"), lambda w: w != "")) >= min_words)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report table as JSON lines or as CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query_text, doc_id, relevance) of a retrieval dataset in one JSON file."""
    schema = "examples array<struct<query_id: string, query_text: string, relevant: array<struct<document_id: string, relevance: int>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("examples").alias("e"))
    return rows.select("e.query_id", "e.query_text", F.explode("e.relevant").alias("r")).select("query_id", "query_text", F.col("r.document_id").alias("doc_id"), F.coalesce("r.relevance", F.lit(1)).alias("relevance"))


def label_sets(spark: SparkSession, path: str) -> DataFrame:
    """(example_id, text, labels) of a classification dataset in one JSON file."""
    schema = "examples array<struct<example_id: string, text: string, labels: array<string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("examples").alias("e")).select("e.*")


def save_judgments(rows: DataFrame, path: str, name: str, version: str = "1.0", description: str = "") -> None:
    """A retrieval dataset(query_id, query_text, doc_id, relevance) as one JSON file, as `judgments` reads it: a set of queries of a size to be judged by hand."""
    one = rows.groupBy("query_id", "query_text").agg(F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("document_id"), "relevance"))).alias("relevant"))
    _save_examples(one.orderBy("query_id"), path, name, version, description)


def save_label_sets(rows: DataFrame, path: str, name: str, version: str = "1.0", description: str = "") -> None:
    """A classification dataset(example_id, text, labels) as one JSON file, as `label_sets` reads it."""
    _save_examples(rows.orderBy("example_id"), path, name, version, description)


def _save_examples(rows: DataFrame, path: str, name: str, version: str, description: str) -> None:
    examples = [json.loads(x) for x in rows.toJSON().collect()]
    write_text(rows.sparkSession, path, json.dumps({"name": name, "version": version, "description": description, "examples": examples}, ensure_ascii=False, indent=2))


def save_comparison(rows: DataFrame, path: str, key: str, name: str, version: str = "1.0") -> None:
    """A comparison with a row for each method, setting or scenario: path.json with the figures of each under its name, and path.csv with a line for each."""
    found = [r.asDict(recursive=True) for r in rows.collect()]
    results = [{"name": r[key], "figures": {k: v for k, v in r.items() if k != key}} for r in found]
    write_text(rows.sparkSession, f"{path}.json", json.dumps({"name": name, "version": version, "results": results}, ensure_ascii=False, indent=2))
    _save_csv(rows.sparkSession, f"{path}.csv", [key, *[c for c in rows.columns if c != key]], found)


def _save_csv(spark: SparkSession, path: str, columns: list[str], rows: list[dict]) -> None:
    out = io.StringIO()
    lines = csv.DictWriter(out, columns, extrasaction="ignore")
    lines.writeheader()
    lines.writerows(rows)
    write_text(spark, path, out.getvalue())


def save_analytics(sections: DataFrame, path: str, name: str, metadata: dict | None = None) -> None:
    """A report of `analytics.composite`(section, group_key, metric, value, kind: group or trend): path.json, path.csv of the groups and path_trend.csv of the points."""
    found = [r.asDict() for r in sections.orderBy("section", "group_key", "metric").collect()]
    by = {}
    for r in found:
        part = by.setdefault(r["section"], {"name": r["section"], "grouped_metrics": [], "trend_series": []})
        part["trend_series" if r["kind"] == "trend" else "grouped_metrics"].append({k: r[k] for k in ("group_key", "metric", "value")})
    write_text(sections.sparkSession, f"{path}.json", json.dumps({"name": name, "metadata": metadata or {}, "sections": list(by.values())}, ensure_ascii=False, indent=2))
    for kind, ending in (("group", ""), ("trend", "_trend")):
        _save_csv(sections.sparkSession, f"{path}{ending}.csv", ["section", "group_key", "metric", "value"], [r for r in found if r["kind"] == kind])
