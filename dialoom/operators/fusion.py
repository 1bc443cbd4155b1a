"""Rank fusion and hybrid retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.errors import ConfigurationError
from dialoom.operators.lexical import ranked
from dialoom.sources.working import kept


@dataclass(frozen=True)
class HybridConfig:
    lexical_top_k: int = 25
    vector_top_k: int = 25
    strategy: str = "rrf"
    semantic_weight: float = 0.5
    rrf_k: int = 60
    final_top_k: int = 10

    def __post_init__(self):
        if self.strategy not in ("rrf", "linear") or not 0 <= self.semantic_weight <= 1:
            raise ConfigurationError("strategy is rrf or linear, and the weight is between 0 and 1")


def _sides(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    name = lambda df, side: df.select("query_id", "doc_id", F.col("rank").alias(f"{side}_rank"), F.col("score").alias(f"{side}_score"))
    return name(lexical, "lexical").join(name(semantic, "semantic"), ["query_id", "doc_id"], "full_outer")


def _finish(scored: DataFrame, top_k: int) -> DataFrame:
    return ranked(scored, "raw", top_k, beside=("lexical_score", "semantic_score"))


def reciprocal_rank(lexical: DataFrame, semantic: DataFrame, k: int = 60, top_k: int = 10) -> DataFrame:
    """The sum of 1/(k+rank) over the sides that found a document."""
    share = lambda side: F.coalesce(1 / (k + F.col(f"{side}_rank")), F.lit(0.0))
    return _finish(_sides(lexical, semantic).withColumn("raw", share("lexical") + share("semantic")), top_k)


def linear(lexical: DataFrame, semantic: DataFrame, semantic_weight: float = 0.5, top_k: int = 10) -> DataFrame:
    """Weighted sum of scores, each side stretched to 0..1 within a query; a side with one value counts 1, an absent side 0."""
    return _finish(_sides(_stretched(lexical), _stretched(semantic)).withColumn("raw", (1 - semantic_weight) * F.coalesce("lexical_score", F.lit(0.0)) + semantic_weight * F.coalesce("semantic_score", F.lit(0.0))), top_k)


def _stretched(hits: DataFrame) -> DataFrame:
    by = Window.partitionBy("query_id")
    low, high = F.min("score").over(by), F.max("score").over(by)
    return hits.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))))


def hybrid(lexical: DataFrame | None, semantic: DataFrame | None, config: HybridConfig = HybridConfig(), query_type: str = "hybrid", top_k: int | None = None, keep: Column | None = None) -> tuple[str, DataFrame]:
    """The mode that was possible, and its hits. Queries for which one side found nothing keep the other's scores."""
    k = top_k or config.final_top_k
    use_lexical, use_semantic = lexical is not None and query_type != "semantic", semantic is not None and query_type != "lexical"
    if not use_lexical and not use_semantic:
        raise ConfigurationError("no index for this type of query")
    restrict = (lambda df: df) if keep is None else (lambda df: df.where(keep))
    if not (use_lexical and use_semantic):
        hits = restrict(lexical if use_lexical else semantic)
        return ("lexical_only" if use_lexical else "semantic_only"), ranked(hits, "score", k)
    lexical, semantic = restrict(lexical.where(F.col("rank") <= config.lexical_top_k)), restrict(semantic.where(F.col("rank") <= config.vector_top_k))
    # Each side is asked for several times, and would be searched as often.
    lexical, semantic = kept(lexical, "hybrid-lexical"), kept(semantic, "hybrid-semantic")
    both = lexical.select("query_id").distinct().join(semantic.select("query_id").distinct(), "query_id")
    fused = reciprocal_rank(lexical, semantic, config.rrf_k, k) if config.strategy == "rrf" else linear(lexical, semantic, config.semantic_weight, k)
    alone = lexical.unionByName(semantic).join(both, "query_id", "left_anti")
    columns = ["query_id", "rank", "doc_id", "score"]
    return "hybrid", fused.join(both, "query_id", "left_semi").select(columns).unionByName(ranked(alone, "score", k).select(columns))


def best_sentence(rows: DataFrame, sentence_scores: DataFrame, key: str = "window_id") -> DataFrame:
    """The most similar sentence of each row, the first of equals. sentence_scores(key, pos, sentence, score)."""
    best = sentence_scores.groupBy(key).agg(F.min_by("sentence", F.struct(-F.col("score"), F.col("pos"))).alias("best_sentence"), F.count(F.lit(1)).alias("_n"))
    return rows.join(best.where("_n >= 2").drop("_n"), key, "left")


def sentences(text: Column) -> Column:
    """Split at line ends or after . ! ?, speaker tags dropped, of more than five characters."""
    parts = F.split(text, r"\n|(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\[\w+\]\s*", ""))), lambda s: F.char_length(s) > 5)
