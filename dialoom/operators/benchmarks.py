"""One input under several settings: rules, classifiers, analytics queries, and whole pipelines, side by side.

Each comparison is one table with a row for each setting; wall times, where they are taken, are of the action that fills the row.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import analytics, evaluation
from dialoom.pipeline import STAGES, PipelineResult
from dialoom.plans import rules as R


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rules(inputs: DataFrame, rules_: list[R.Rule], settings: dict[str, dict]) -> DataFrame:
    """A row for each setting, which holds arguments of `rules.evaluate`: rates, and tests in the evidence by outcome and family."""
    parts = []
    for name, options in settings.items():
        out = R.evaluate(inputs, rules_, **options)
        tests = lambda keep: F.coalesce(F.sum(F.size(F.filter("evidence", keep))), F.lit(0))
        rate = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)), 4)
        of_family = lambda f: lambda e: e["family"] == f
        families = [tests(of_family(f)).alias(f) for f in R.COST]
        parts.append(out.agg(
            F.lit(name).alias("setting"), F.count(F.lit(1)).alias("results"), F.count_if("matched").alias("matched"), rate("matched").alias("match_rate"), F.count_if("short_circuited").alias("short_circuited"),
            rate("short_circuited").alias("short_circuit_rate"), tests(lambda e: F.lit(True)).alias("tests"), tests(lambda e: e["matched"]).alias("tests_matched"), *families,
        ))
    return _stacked(parts)


def timed(table: DataFrame) -> tuple[DataFrame, float]:
    """A comparison's rows, brought to the driver, and the milliseconds that took."""
    start = time.monotonic()
    rows = table.collect()  # a row per setting
    return table.sparkSession.createDataFrame(rows, table.schema), round((time.monotonic() - start) * 1000, 2)


def predicted(results: DataFrame, threshold: float | None = None) -> DataFrame:
    """(example_id, label) of the labels a classifier gives, by their own thresholds or by one for all."""
    s = results.select(F.col("source_id").alias("example_id"), F.explode("scores").alias("s"))
    return s.where(F.col("s.is_positive") if threshold is None else F.col("s.score") >= threshold).select("example_id", "s.label")


def classifiers(methods: dict[str, DataFrame], truth: DataFrame, labels: tuple[str, ...], threshold: float | None = None) -> DataFrame:
    """A row for each method's results(source_id, scores): means over the examples, and F1 over all labels, those without a row included.

    truth(example_id, label) has a row for each true label, and one without a label for an example that has none.
    """
    parts = []
    names = truth.sparkSession.createDataFrame([(n,) for n in labels], "label string")
    ids = truth.select("example_id").distinct()
    for name, results in methods.items():
        p = predicted(results, threshold).withColumn("predicted", F.lit(True))
        both = truth.where("label is not null").withColumn("truth", F.lit(True)).join(p, ["example_id", "label"], "full_outer").fillna(False, ["predicted", "truth"])
        both = both.join(ids, "example_id", "left_semi")
        sums = both.groupBy("example_id").agg(F.count_if(F.col("predicted") & F.col("truth")).alias("b"), F.count_if("predicted").alias("p"), F.count_if("truth").alias("t"))
        each = ids.join(sums, "example_id", "left").fillna(0)
        ratio = lambda a, b: F.round(F.avg(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))), 4)
        means = each.agg(F.count(F.lit(1)).alias("examples"), ratio(F.col("b"), F.col("p")).alias("mean_precision"), ratio(F.col("b"), F.col("t")).alias("mean_recall"), ratio(2 * F.col("b"), F.col("p") + F.col("t")).alias("mean_f1"))
        seen = names.join(evaluation.per_label(both.select("label", "predicted", "truth")), "label", "left").fillna(0)
        # One row each: broadcasts of proven size.
        parts.append(means.join(F.broadcast(evaluation.micro_macro(seen))).select(F.lit(name).alias("method"), "*"))
    return _stacked(parts)


def queries(events: DataFrame, groups: dict[str, analytics.AnalyticsQuery], trends: dict[str, tuple[analytics.AnalyticsQuery, str, str]] | None = None) -> DataFrame:
    """A row for each scenario: its kind and how many results it has. events are counted once."""
    total = events.agg(F.count(F.lit(1)).alias("total_events"))
    parts = [_scenario(name, "grouped", analytics.long(analytics.run(events, q)), F.count(F.lit(1)), F.lit(0)) for name, q in groups.items()]
    parts += [_scenario(name, "trend", analytics.run_trend(events, q, metric, window), F.lit(0), F.count(F.lit(1))) for name, (q, metric, window) in (trends or {}).items()]
    return _stacked(parts).join(F.broadcast(total))


def _scenario(name: str, kind: str, rows: DataFrame, groups: Column, points: Column) -> DataFrame:
    return rows.agg(F.lit(name).alias("scenario"), F.lit(kind).alias("query_type"), groups.cast("bigint").alias("group_count"), points.cast("bigint").alias("trend_point_count"))


def pipelines(spark: SparkSession, scenarios: dict[str, Callable[[], PipelineResult]]) -> DataFrame:
    """(scenario, stage, item_count, skipped, elapsed_ms) of pipelines, each a function that gives a PipelineResult; the time is that of counting a stage's rows."""
    rows = []
    for name, make in scenarios.items():
        result = make()
        tables = dict(zip(STAGES, (result.windows, result.embeddings, result.index and result.index.stats, result.predictions, result.rules, result.events), strict=True))
        for stage, table in tables.items():
            start = time.monotonic()
            n = 0 if table is None else table.first()["documents"] if stage == "index" else table.count()
            rows.append((name, stage, n, table is None, round((time.monotonic() - start) * 1000, 2)))
    return spark.createDataFrame(rows, "scenario string, stage string, item_count bigint, skipped boolean, elapsed_ms double")
