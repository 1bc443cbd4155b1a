"""The search surface: checked requests, hits with what is known of their windows, reranking, and lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.errors import ValidationError
from dialoom.functions import text as T
from dialoom.protocols import Reranker

#: The least and greatest lengths of a query, of rule text and of a category's name, and of top_k.
QUERY_LENGTH, RULE_LENGTH, NAME_LENGTH, TOP_K = (1, 500), (1, 2000), (1, 200), (1, 100)
PREVIEW = 500


def within(what: str, value: int, bounds: tuple[int, int]) -> None:
    if not bounds[0] <= value <= bounds[1]:
        raise ValidationError(f"{what} is {value}, and is to be {bounds[0]} to {bounds[1]}")


@dataclass(frozen=True)
class SearchRequest:
    """Filters are of the speaker (accepted, without effect), the domain and the topic of a window."""

    query: str
    top_k: int = 20
    speaker: str | None = None
    domain: str | None = None
    topic: str | None = None

    def __post_init__(self):
        within("the length of a query", len(self.query), QUERY_LENGTH)
        within("top_k", self.top_k, TOP_K)


def enrich(hits: DataFrame, store: DataFrame, id_col: str = "window_id", domain: str | None = None, topic: str | None = None, top_k: int = 20) -> DataFrame:
    """hits(query_id, rank, doc_id, …) with the columns of store(id_col, domain, topic, …).

    Hits that the store does not know go. The filters come after the ranking, so fewer than top_k may be left; ranks are counted anew.
    """
    out = hits.join(store.withColumnRenamed(id_col, "doc_id"), "doc_id")
    for column, wanted in (("domain", domain), ("topic", topic)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))
    return out.withColumn("rank", again).where(F.col("rank") <= top_k)


def with_metadata(hits: DataFrame, store: DataFrame, id_col: str = "doc_id", object_type: str = "context_window") -> DataFrame:
    """hits with object_type and metadata, a map of the store's other columns as text; a column object_type of the store goes first."""
    others = [c for c in store.columns if c not in (id_col, "text", "object_type")]
    pairs = [x for c in others for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    kind = F.coalesce("object_type", F.lit(object_type)) if "object_type" in store.columns else F.lit(object_type)
    known = store.select(F.col(id_col).alias("doc_id"), kind.alias("object_type"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"))
    return hits.join(known, "doc_id")


def embedding_metadata(embeddings: DataFrame) -> DataFrame:
    """(doc_id, metadata): what a hit tells of the vector that it was found by."""
    names = ("model_name", "model_version", "pooling_strategy", "embedding_id")
    return embeddings.select(F.col("source_id").alias("doc_id"), F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]).alias("metadata"))


def rerank(queries: DataFrame, hits: DataFrame, reranker: Reranker, top_k: int = 10) -> DataFrame:
    """The hits in the order of a reranker's scores; those without one keep their order behind the others."""
    scores = reranker.rerank(queries, hits).select("query_id", "doc_id", F.round("score", 9).alias("new"))
    both = hits.join(scores, ["query_id", "doc_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("new").desc_nulls_last(), "rank", "doc_id")
    return both.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top_k).select("query_id", F.col("at").alias("rank"), "doc_id", F.round("new", 6).alias("score"))


@dataclass(frozen=True)
class TermCoverage:
    """A reranker: the share of a query's different terms that the text of a hit holds. texts(doc_id, text)."""

    texts: DataFrame

    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        asked = queries.select("query_id", F.array_distinct(T.tokens(F.col("query_text"))).alias("asked"))
        rows = hits.select("query_id", "doc_id").join(asked, "query_id").join(self.texts.select("doc_id", "text"), "doc_id")
        held = F.size(F.array_intersect("asked", T.tokens(F.coalesce("text", F.lit("")))))
        return rows.select("query_id", "doc_id", F.coalesce(held / F.nullif(F.size("asked"), F.lit(0)), F.lit(0.0)).alias("score"))


@dataclass(frozen=True)
class ConversationStore:
    """conversations(conversation_id, domain, topic, asr_confidence, turn_count, text, …) and windows(window_id, conversation_id, …), as tables that are filtered by key."""

    conversations: DataFrame
    windows: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ConversationStore:
        return cls(spark.read.json(f"{path}/conversations.json", multiLine=True), spark.read.json(f"{path}/windows.json", multiLine=True))

    def conversation(self, conversation_id: str) -> DataFrame:
        return self.conversations.where(F.col("conversation_id") == conversation_id)

    def window(self, window_id: str) -> DataFrame:
        return self.windows.where(F.col("window_id") == window_id)

    def conversation_of(self, window_id: str) -> DataFrame:
        return self.conversations.join(self.window(window_id).select("conversation_id"), "conversation_id", "left_semi")

    def facets(self) -> DataFrame:
        """(facet, value): the domains and topics there are; without one: unknown."""
        pair = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in ("domain", "topic")]))
        return self.conversations.select(pair.alias("p")).select("p.*").distinct()

    def summary(self) -> DataFrame:
        """Per domain, most first: conversations, mean turns, mean confidence of the speech recogniser; a missing figure counts 0."""
        by = self.conversations.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain"))
        mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 4)
        return by.agg(F.count(F.lit(1)).alias("conversations"), mean("turn_count").alias("avg_turns"), mean("asr_confidence").alias("avg_asr_confidence")).orderBy(F.desc("conversations"), "domain")


def conversation_view(conversations: DataFrame, turns: DataFrame, windows: DataFrame, text: Column | None = None) -> DataFrame:
    """One row per conversation: counts, the start of its text, and its turns in order. turns(conversation_id, ord, speaker, text)."""
    spoken = turns.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("ord", "speaker", "text"))).alias("turns"))
    counted = windows.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("window_count"))
    whole = F.array_join(F.transform("turns", lambda t: t["text"]), "\n") if text is None else text
    out = conversations.join(spoken, "conversation_id", "left").join(counted, "conversation_id", "left")
    return out.withColumn("turns", F.coalesce("turns", F.array().cast(spoken.schema["turns"].dataType))).select("*", F.size("turns").alias("turn_count"), F.substring(whole, 1, PREVIEW).alias("text_preview")).fillna(0, ["window_count"])

