"""Table schemas, allowed values and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.errors import ValidationError

TRANSCRIPTS = "conversation_id string, channel string, source_format string, raw_text string, speaker_hints array<struct<speaker_label: string, role: string>>, quality_signals struct<asr_confidence: double, language_code: string, audio_duration_ms: bigint, word_error_rate: double>, metadata map<string, string>"
CONVERSATIONS = "conversation_id string, channel string, start_time timestamp, end_time timestamp, customer_id string, product string, queue string, region string, metadata map<string, string>"
TURNS = "turn_id string, conversation_id string, idx int, speaker string, raw_text string, normalized_text string, start_offset int, end_offset int"
WINDOWS = "window_id string, conversation_id string, turn_ids array<string>, window_text string, start_index int, end_index int, window_size int, stride int"
EMBEDDINGS = "embedding_id string, source_id string, source_type string, model_name string, model_version string, pooling_strategy string, dimensions int, vector array<float>"
PREDICTIONS = "prediction_id string, source_id string, source_type string, label string, score double, confidence double, threshold double, is_above_threshold boolean"
EVENTS = "event_id string, event_type string, source_id string, source_type string, ts timestamp, metric_type string, value double, label string, matched boolean, metadata map<string, string>"

#: Fixed values of the data model.
SPEAKERS = ("customer", "agent", "system", "unknown")
CHANNELS = ("voice", "chat", "email", "ticket")
OBJECT_TYPES = ("turn", "context_window", "conversation")
POOLING = ("mean", "max", "attention")
SOURCE_FORMATS = ("labeled", "multiline", "plain")
LEVELS = ("turn", "context_window", "conversation", "system")
METRIC_TYPES = ("classification", "rule", "retrieval", "pipeline")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _outside(c: str, low: float, high: float) -> Column:
    return ~F.col(c).between(low, high)


CHECKS: dict[str, dict[str, Column | object]] = {
    "transcripts": {"blank id": lambda: _blank("conversation_id"), "blank text": lambda: _blank("raw_text"), "unknown channel": lambda: ~F.col("channel").isin(*CHANNELS)},
    "conversations": {"blank id": lambda: _blank("conversation_id"), "ends before it starts": lambda: F.col("end_time") < F.col("start_time")},
    "turns": {"blank id": lambda: _blank("turn_id"), "negative start": lambda: F.col("start_offset") < 0, "empty span": lambda: F.col("end_offset") <= F.col("start_offset")},
    "windows": {"blank id": lambda: _blank("window_id"), "no turns": lambda: F.size("turn_ids") < 1, "size differs": lambda: F.size("turn_ids") != F.col("window_size"), "stride below one": lambda: F.col("stride") < 1},
    "embeddings": {"blank id": lambda: _blank("source_id"), "size differs": lambda: F.size("vector") != F.col("dimensions")},
    "predictions": {"score": lambda: _outside("score", 0, 1), "confidence": lambda: _outside("confidence", 0, 1), "flag": lambda: F.col("is_above_threshold") != (F.col("score") >= F.col("threshold"))},
}


def violations(df: DataFrame, table: str) -> DataFrame:
    """df with `violations`: the names of the checks that a row breaks."""
    codes = F.array(*[F.when(F.coalesce(test(), F.lit(False)), F.lit(name)) for name, test in CHECKS[table].items()])
    return df.withColumn("violations", F.filter(codes, lambda x: x.isNotNull()))


def validate(df: DataFrame, table: str) -> DataFrame:
    """df, or a failure of the job at the first bad row."""
    if table not in CHECKS:
        raise ValidationError(f"no checks for {table}")
    checked = violations(df, table)
    ok = F.assert_true(F.size("violations") == 0, F.concat(F.lit(f"{table}: "), F.array_join("violations", ", "))).isNull()
    return checked.where(ok).drop("violations")
