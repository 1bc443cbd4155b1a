"""Events by dimension and by time."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.errors import ConfigurationError

#: Names of time windows and their units.
UNITS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}
ATTRIBUTES = ("event_id", "event_type", "source_id", "source_type", "metric_type", "label", "matched", "value")


@dataclass(frozen=True)
class AnalyticsQuery:
    query_id: str = "query"
    metric_types: tuple[str, ...] = ()
    start_time: datetime | None = None
    end_time: datetime | None = None
    group_by: str = "metric_type"
    filters: dict[str, str] = field(default_factory=dict)
    max_results: int = 100


def _attribute(name: str) -> Column:
    """Metadata first, then the column of that name, as text."""
    own = F.col(name).cast("string") if name in ATTRIBUTES else F.lit(None).cast("string")
    return F.coalesce(F.element_at("metadata", F.lit(name)), own)


def filter_events(events: DataFrame, query: AnalyticsQuery) -> DataFrame:
    """All conditions together; both time bounds count as inside."""
    out = events
    if query.metric_types:
        out = out.where(F.col("metric_type").isin(*query.metric_types))
    if query.start_time is not None:
        out = out.where(F.col("ts") >= F.lit(query.start_time))
    if query.end_time is not None:
        out = out.where(F.col("ts") <= F.lit(query.end_time))
    for key, value in query.filters.items():
        out = out.where(F.coalesce(_attribute(key) == value, F.lit(False)))
    return out


def _metrics() -> list[Column]:
    rate = F.avg(F.coalesce(F.col("matched"), F.lit(False)).cast("int"))
    return [F.count(F.lit(1)).alias("event_count"), F.round(F.avg("value"), 4).alias("avg_value"), F.round(rate, 4).alias("match_rate")]


def by_dimension(events: DataFrame, key: str) -> DataFrame:
    """One row per value of the dimension; rows without it are `unknown`. With the commonest metric type."""
    rows = events.withColumn("group_key", F.coalesce(_attribute(key), F.lit("unknown")))
    types = rows.groupBy("group_key", "metric_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    top = types.groupBy("group_key").agg(F.min_by("metric_type", F.struct(-F.col("n"), F.col("first"), F.col("metric_type"))).alias("dominant_type"))
    return rows.groupBy("group_key").agg(*_metrics()).join(top, "group_key")


def trend(events: DataFrame, metric: str, window: str) -> DataFrame:
    """(bucket, value), without rows for empty buckets. A metric other than the match rate and the count is the mean value."""
    if window not in UNITS:
        raise ConfigurationError(f"no window {window}")
    value = {"match_rate": F.avg(F.coalesce(F.col("matched"), F.lit(False)).cast("int")), "event_count": F.count(F.lit(1)).cast("double")}.get(metric, F.avg("value"))
    return events.groupBy(F.date_trunc(UNITS[window], "ts").alias("bucket")).agg(F.round(value, 4).alias("value"))


def run(events: DataFrame, query: AnalyticsQuery) -> DataFrame:
    return by_dimension(filter_events(events, query), query.group_by).orderBy("group_key").limit(query.max_results)


def run_trend(events: DataFrame, query: AnalyticsQuery, metric: str, window: str) -> DataFrame:
    return trend(filter_events(events, query), metric, window).orderBy("bucket").limit(query.max_results)


def long(grouped: DataFrame) -> DataFrame:
    """(group_key, metric, value): one row for each metric of a group."""
    return grouped.selectExpr("group_key", "stack(3, 'event_count', cast(event_count as double), 'avg_value', avg_value, 'match_rate', match_rate) as (metric, value)")


def composite(events: DataFrame, queries: list[AnalyticsQuery], trends: list[tuple[AnalyticsQuery, str, str]] = ()) -> DataFrame:
    """Sections of a report under one another."""
    out = None
    for q in queries:
        part = long(run(events, q)).select(F.lit(q.query_id).alias("section"), "group_key", "metric", "value")
        out = part if out is None else out.unionByName(part)
    for q, metric, window in trends:
        part = run_trend(events, q, metric, window).select(F.lit(q.query_id).alias("section"), F.date_format("bucket", "yyyy-MM-dd'T'HH:mm:ss").alias("group_key"), F.lit(metric).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ConfigurationError("a report has a section at least")
    return out


def stats(events: DataFrame) -> DataFrame:
    return events.agg(*_metrics(), F.countDistinct("metric_type").alias("metric_types"))


def types(events: DataFrame) -> DataFrame:
    """(metric_type, events, matched)."""
    return events.groupBy("metric_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.coalesce("matched", F.lit(False))).alias("matched"))


def append(events: DataFrame, more: DataFrame) -> DataFrame:
    return events.unionByName(more)


def report_metadata(query: AnalyticsQuery, result_count: int, elapsed_ms: float) -> dict:
    """What a report says of its query; settings that were not made are left out."""
    made = {"group_by": query.group_by, "metric_types": list(query.metric_types), "start_time": query.start_time and query.start_time.isoformat(), "end_time": query.end_time and query.end_time.isoformat(), "filters": query.filters}
    return {"query_id": query.query_id, "result_count": result_count, "generation_time_ms": elapsed_ms} | {k: v for k, v in made.items() if v}


def report_metrics(reports: DataFrame) -> DataFrame:
    """One row on reports(group_count, trend_point_count, total_events, generation_time_ms); without reports all is 0."""
    results = F.col("group_count") + F.col("trend_point_count")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return reports.agg(
        F.count(F.lit(1)).alias("report_count"), mean("generation_time_ms").alias("avg_generation_time_ms"), mean(results).alias("avg_result_count"), mean((results == 0).cast("int")).alias("empty_report_rate"),
        mean("group_count").alias("avg_group_count"), mean("trend_point_count").alias("avg_trend_point_count"), F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events_considered"),
    )


def events_of_predictions(predictions: DataFrame, ts: Column) -> DataFrame:
    return predictions.select(
        F.concat(F.lit("evt_"), "prediction_id").alias("event_id"), F.lit("prediction").alias("event_type"), F.col("source_id").cast("string").alias("source_id"), "source_type", ts.alias("ts"),
        F.lit("classification").alias("metric_type"), F.col("score").alias("value"), "label", F.col("is_above_threshold").alias("matched"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def events_of_rules(executions: DataFrame, ts: Column) -> DataFrame:
    return executions.select(
        F.concat_ws("_", F.lit("evt"), "rule_id", F.col("source_id").cast("string")).alias("event_id"), F.lit("rule_execution").alias("event_type"), F.col("source_id").cast("string").alias("source_id"), F.lit("context_window").alias("source_type"), ts.alias("ts"),
        F.lit("rule").alias("metric_type"), F.col("score").alias("value"), F.col("rule_id").alias("label"), "matched", F.create_map(F.lit("rule_id"), F.col("rule_id")).alias("metadata"),
    )


def events_table(events: DataFrame, threshold: float = 50.0) -> DataFrame:
    """The event stream table in the shape of analytics events."""
    return events.select(
        F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("user_id").cast("string").alias("source_id"), F.lit("conversation").alias("source_type"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("metric_type"), "value", F.lit(None).cast("string").alias("label"), (F.col("value") >= threshold).alias("matched"), F.from_json("props", "map<string,string>").alias("metadata"),
    )
