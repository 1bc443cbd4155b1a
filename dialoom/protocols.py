"""Extension points: what a component has to offer to take the place of one of the library's own.

Rows come and go as DataFrames, so a component may be made of column functions, of Arrow-batched functions, or of
calls to a service inside `mapInPandas`.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Segmenter(Protocol):
    def segment(self, transcripts: DataFrame) -> DataFrame:
        """Turns (conversation_id, idx, speaker, raw_text, normalized_text, …) of transcripts."""
        ...


@runtime_checkable
class ContextBuilder(Protocol):
    def build(self, turns: DataFrame) -> DataFrame:
        """Windows (window_id, conversation_id, window_text, …) of turns."""
        ...


@runtime_checkable
class EmbeddingGenerator(Protocol):
    def generate(self, rows: DataFrame) -> DataFrame:
        """rows(source_id, text) with `vector`."""
        ...


@runtime_checkable
class VectorIndex(Protocol):
    def upsert(self, rows: DataFrame) -> None: ...

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score) for queries(query_id, query_vector)."""
        ...


@runtime_checkable
class LexicalSearcher(Protocol):
    def append(self, documents: DataFrame) -> LexicalSearcher: ...

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score) for queries(query_id, query_text)."""
        ...


@runtime_checkable
class HybridRetriever(Protocol):
    def retrieve(self, queries: DataFrame, top_k: int = 10) -> DataFrame: ...


@runtime_checkable
class Reranker(Protocol):
    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        """New scores (query_id, doc_id, score) of some or all hits(query_id, rank, doc_id, score)."""
        ...


@runtime_checkable
class Classifier(Protocol):
    def classify(self, inputs: DataFrame) -> DataFrame:
        """(source_id, scores): an array of label, score, confidence, threshold and is_positive, best first."""
        ...


@runtime_checkable
class RuleCompiler(Protocol):
    def compile(self, source: str, rule_id: str, name: str) -> object: ...


@runtime_checkable
class RuleEvaluator(Protocol):
    def evaluate(self, rules: list, inputs: DataFrame) -> DataFrame:
        """A row per input and rule, as `plans.rules.evaluate` gives them."""
        ...


@runtime_checkable
class AnalyticsAggregator(Protocol):
    def aggregate(self, events: DataFrame, key: str) -> DataFrame: ...


@runtime_checkable
class AnalyticsReporter(Protocol):
    def query(self, events: DataFrame, query: object) -> DataFrame: ...

    def trend(self, events: DataFrame, query: object, metric: str, window: str) -> DataFrame: ...
