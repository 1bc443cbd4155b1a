"""Transcripts to turns."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.errors import ConfigurationError
from dialoom.functions import text as T

#: Fixed value: the default speaker label, upper case only, at the start of a line.
LABEL = r"^(CUSTOMER|AGENT|SYSTEM|UNKNOWN)\s*:"
_PARTS = "array<struct<ord: int, label: string, text: string, start_offset: int, end_offset: int>>"


@dataclass(frozen=True)
class SegmentationConfig:
    merge_consecutive: bool = True
    normalize_unicode: bool = True
    strip_lines: bool = True
    collapse_whitespace: bool = True
    min_turn_chars: int = 1
    max_turn_chars: int = 10_000
    label_pattern: str = LABEL

    def __post_init__(self):
        if self.min_turn_chars < 1 or self.max_turn_chars < self.min_turn_chars:
            raise ConfigurationError("min_turn_chars is at least 1 and at most max_turn_chars")


def labelled_parts(pattern: str):
    """A vectorised function: the labelled parts of each text with offsets. Text before the first label is dropped."""
    label = re.compile(pattern, re.MULTILINE)

    def parts(text: str) -> list[dict]:
        found = list(label.finditer(text))
        if not found:
            return [{"ord": 0, "label": None, "text": text.strip(), "start_offset": 0, "end_offset": len(text)}] if text.strip() else []
        ends = [m.start() for m in found[1:]] + [len(text)]
        cut = [(m.group(1), text[m.end() : end].strip(), m.start(), end) for m, end in zip(found, ends, strict=True)]
        return [{"ord": i, "label": a, "text": b, "start_offset": c, "end_offset": d} for i, (a, b, c, d) in enumerate(cut) if b]

    @F.pandas_udf(_PARTS)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: parts(t or ""))

    return run


def _line_parts(text: Column) -> Column:
    """One part for each line that is not blank. Offsets are those of the stripped line."""
    lines = F.split(text, "\n")
    state = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast(_PARTS).alias("parts")),
        lambda a, line: F.struct(
            (a["at"] + F.char_length(line) + 1).alias("at"),
            F.when(T.words(line) == F.array().cast("array<string>"), a["parts"]).otherwise(F.concat(a["parts"], F.array(_stripped(line, a["at"], F.size(a["parts"]))))).alias("parts"),
        ),
        lambda a: a["parts"],
    )
    return state


def _stripped(line: Column, at: Column, ord_: Column) -> Column:
    lead = F.char_length(line) - F.char_length(F.regexp_replace(line, r"(?U)^\s+", ""))
    body = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return F.struct(ord_.alias("ord"), F.lit(None).cast("string").alias("label"), body.alias("text"), (at + lead).alias("start_offset"), (at + lead + F.char_length(body)).alias("end_offset"))


def speaker_of(label: Column, hints: Column) -> Column:
    """The hinted role of a label, else the label if it is a role, else unknown. Of hints for one label the last wins."""
    key = F.upper(F.trim(label))
    hinted = F.element_at(F.filter(hints, lambda h: F.upper(F.trim(h["speaker_label"])) == key), -1)["role"]
    role = F.lower(F.trim(F.when(F.size(F.filter(hints, lambda h: F.upper(F.trim(h["speaker_label"])) == key)) > 0, hinted)))
    known = lambda c: F.when(c.isin("customer", "agent", "system"), c)
    return F.when(role.isNotNull(), F.coalesce(known(role), F.lit("unknown"))).otherwise(F.coalesce(known(F.lower(key)), F.lit("unknown")))


def raw_turns(transcripts: DataFrame, config: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """(conversation_id, ord, speaker, text, start_offset, end_offset) by each transcript's source_format."""
    whole = F.array(F.struct(F.lit(0).alias("ord"), F.lit(None).cast("string").alias("label"), F.regexp_replace("raw_text", r"(?U)^\s+|\s+$", "").alias("text"), F.lit(0).alias("start_offset"), F.char_length("raw_text").alias("end_offset")))
    labelled = transcripts.where("source_format = 'labeled'").withColumn("parts", labelled_parts(config.label_pattern)("raw_text"))
    others = transcripts.where("source_format <> 'labeled'").withColumn("parts", F.when(F.col("source_format") == "multiline", _line_parts(F.col("raw_text"))).otherwise(whole.cast(_PARTS)))
    rows = labelled.unionByName(others).select("conversation_id", F.coalesce("speaker_hints", F.array().cast("array<struct<speaker_label: string, role: string>>")).alias("hints"), F.explode("parts").alias("p"))
    return rows.select("conversation_id", "p.ord", speaker_of(F.col("p.label"), F.col("hints")).alias("speaker"), "p.text", "p.start_offset", "p.end_offset").where("text <> ''")


def merge_consecutive(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Neighbouring turns of one speaker as one: texts joined by line ends, the first start, the last end."""
    by = Window.partitionBy(key).orderBy("ord")
    change = F.coalesce((F.col("speaker") != F.lag("speaker").over(by)).cast("int"), F.lit(1))
    island = turns.withColumn("change", change).withColumn("island", F.sum("change").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = island.groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "start_offset", "end_offset", "speaker"))).alias("parts"))
    first, last = F.element_at("parts", 1), F.element_at("parts", -1)
    return rows.select(key, first["ord"].alias("ord"), first["speaker"].alias("speaker"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), first["start_offset"].alias("start_offset"), last["end_offset"].alias("end_offset"))


def filter_short(turns: DataFrame, least: int, column: str = "text") -> DataFrame:
    return turns.where(F.char_length(column) >= least)


def segment(transcripts: DataFrame, config: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """Turns of each transcript; those kept are numbered from 0."""
    turns = raw_turns(transcripts, config)
    if config.merge_consecutive:
        turns = merge_consecutive(turns)
    turns = turns.withColumn("normalized_text", T.normalize(F.col("text"), config.normalize_unicode, config.strip_lines, config.collapse_whitespace))
    turns = filter_short(turns.withColumn("bare", F.regexp_replace("normalized_text", r"(?U)^\s+|\s+$", "")), config.min_turn_chars, "bare").drop("bare")
    idx = F.row_number().over(Window.partitionBy("conversation_id").orderBy("ord")) - 1
    return turns.withColumn("idx", idx).select(F.concat_ws("_", "conversation_id", F.lit("turn"), "idx").alias("turn_id"), "conversation_id", "idx", "speaker", F.col("text").alias("raw_text"), "normalized_text", "start_offset", "end_offset")


def turns_of_chat(chat: DataFrame) -> DataFrame:
    """Turns of a chat table (conv_id, turn, role, text)."""
    role = F.lower("role")
    speaker = F.when(role == "user", "customer").when(role == "assistant", "agent").when(role.isin("customer", "agent", "system"), role).otherwise("unknown")
    return chat.select(F.col("conv_id").alias("conversation_id"), F.col("turn").cast("int").alias("ord"), speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("start_offset"), F.char_length(F.coalesce("text", F.lit(""))).alias("end_offset"))
