"""Quality of retrieval and classification, from rank and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval(hits: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """Per judged query: recall@k, precision@k, reciprocal rank, nDCG@k. Queries without hits count 0; precision divides by k.

    hits(query_id, rank, doc_id); judgments(query_id, doc_id, relevance).
    """
    positive = judgments.where("relevance > 0")
    found = hits.join(positive, ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("got"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1))).alias("dcg")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    best = judgments.withColumn("rank", F.row_number().over(order))
    ideal = best.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("relevant"), F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1))).alias("ideal"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(found, "query_id", "left").select(
        "query_id", zero(F.col("got") / F.nullif("relevant", F.lit(0))).alias("recall"), zero(F.col("got") / F.lit(float(k))).alias("precision"), zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.col("dcg") / F.nullif("ideal", F.lit(0.0))).alias("ndcg")
    )


def retrieval_summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(n) for c, n in (("recall", "recall"), ("precision", "precision"), ("reciprocal_rank", "mrr"), ("ndcg", "ndcg"))])


def retrieval_report(hits: DataFrame, judgments: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(k, queries, recall, precision, mrr, ndcg): means over the judged queries at several cut-offs; the reciprocal rank is the same at each."""
    out = [retrieval_summary(retrieval(hits, judgments, k)).withColumn("k", F.lit(k)) for k in at]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select("k", "queries", "recall", "precision", "mrr", "ndcg")


def _ratio(a, b):
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)


def per_label(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, support) from pairs(label, predicted, truth), flags of an example and label each."""
    n = pairs.groupBy("label").agg(F.count_if(F.col("predicted") & F.col("truth")).alias("tp"), F.count_if(F.col("predicted") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("predicted") & F.col("truth")).alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def micro_macro(labels: DataFrame) -> DataFrame:
    s = labels.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1"))
    return s.select(F.round(_ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4).alias("micro_f1"), F.round("macro_f1", 4).alias("macro_f1"))


def set_scores(examples: DataFrame) -> DataFrame:
    """Per example: precision, recall and F1 of its label sets; empty sets count 0. examples(example_id, predicted, truth)."""
    both = F.size(F.array_intersect("predicted", "truth"))
    p, r = _ratio(both, F.size(F.array_distinct("predicted"))), _ratio(both, F.size(F.array_distinct("truth")))
    return examples.select("example_id", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def stage_metrics(runs: DataFrame) -> DataFrame:
    """Per stage of pipeline runs: mean time of those not skipped, share skipped, mean items. runs(stage, elapsed_ms, item_count, skipped)."""
    return runs.groupBy("stage").agg(F.round(F.avg(F.when(~F.col("skipped"), F.col("elapsed_ms"))), 4).alias("mean_ms"), F.round(F.avg(F.col("skipped").cast("int")), 4).alias("skip_rate"), F.round(F.avg("item_count"), 4).alias("mean_items"), F.sum("item_count").alias("items"))


def percentiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    return df.agg(*[F.percentile(column, p).alias(f"p{round(p * 100)}") for p in at])
