"""BM25 over an inverted index kept as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.errors import ConfigurationError
from dialoom.functions import text as T
from dialoom.sources.working import kept


@dataclass(frozen=True)
class LexicalConfig:
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ConfigurationError("k1 is not negative and b is between 0 and 1")


@dataclass
class LexicalIndex:
    """postings(term, doc_id, tf, dl), df(term, df) and stats(documents, avg_length, vocabulary)."""

    postings: DataFrame
    df: DataFrame
    stats: DataFrame
    config: LexicalConfig = LexicalConfig()

    def save(self, path: str) -> None:
        for name in ("postings", "df", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: LexicalConfig = LexicalConfig()) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "df", "stats")), config)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
        """The index of the old and the new documents; only the new ones are tokenised. Ids are taken to be new."""
        new = index(docs, id_col, text_col, self.config)
        df = self.df.unionByName(new.df).groupBy("term").agg(F.sum("df").alias("df"))
        both = self.stats.unionByName(new.stats)
        length = F.sum(F.col("documents") * F.col("avg_length")) / F.nullif(F.sum("documents"), F.lit(0))
        stats = both.agg(F.sum("documents").alias("documents"), F.coalesce(length, F.lit(0.0)).alias("avg_length")).join(df.agg(F.count(F.lit(1)).alias("vocabulary")))
        return LexicalIndex(self.postings.unionByName(new.postings), df, stats, self.config)

    def clear(self) -> LexicalIndex:
        none = [t.limit(0) for t in (self.postings, self.df)]
        return LexicalIndex(*none, self.stats.select(F.lit(0).cast("bigint").alias("documents"), F.lit(0.0).alias("avg_length"), F.lit(0).cast("bigint").alias("vocabulary")), self.config)

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return search(self, queries, top_k)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: LexicalConfig = LexicalConfig()) -> LexicalIndex:
    """Read and tokenised once, into a working table that all parts of the index are made of; a document without terms counts for the average length only."""
    rows = docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    rows = kept(rows, "bm25-terms").withColumn("dl", F.size("terms"))
    postings = rows.select("doc_id", "dl", F.explode("terms").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # The vocabulary is a subquery, as a search does not ask for it: a join would count all postings all the same.
    vocabulary = F.coalesce(df.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    stats = rows.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_length")).withColumn("vocabulary", vocabulary)
    return LexicalIndex(postings, df, stats, config)


def search(ix: LexicalIndex, queries: DataFrame, top_k: int = 10, query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """(query_id, rank, doc_id, score) of the top_k for each query.

    The queries' terms cut the postings down before they are counted or scored, and only their frequencies are asked for; a term that a query repeats counts
    as often. Scores rank at nine places, so that the order of summing does not matter; equal ones rank by doc_id.
    Scores come at six places.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(T.tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    k1, b = ix.config.k1, ix.config.b
    # One row of statistics: a broadcast of proven size.
    cut = kept(ix.postings.join(asked.select("term").distinct(), "term", "left_semi"), "bm25-postings")
    df = cut.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # Written, so that its size is known when the join is planned. Where it is small, all rows of a document are in one task, and sums need no exchange.
    weighed = kept(asked.join(df, "term"), "bm25-asked")
    hits = cut.repartition("doc_id").join(weighed, "term").join(F.broadcast(ix.stats.select("documents", "avg_length")))
    idf = F.log((F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_length"))
    scored = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * idf * F.col("tf") * (k1 + 1) / norm).alias("raw")).where("raw > 0")
    return ranked(scored, "raw", top_k, by=F.round("raw", 9))


def ranked(scored: DataFrame, column: str, top_k: int, item: str = "doc_id", beside: tuple[str, ...] = (), by: Column | None = None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy((F.col(column) if by is None else by).desc(), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", item, F.round(column, 6).alias("score"), *beside)
