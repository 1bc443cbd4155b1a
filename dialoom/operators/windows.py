"""Sliding context windows over turns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.errors import ConfigurationError
from dialoom.functions import text as T


@dataclass(frozen=True)
class WindowConfig:
    window_size: int = 5
    stride: int = 2
    min_window_size: int = 1
    include_partial_tail: bool = True
    labels: bool = True
    delimiter: str = "\n"

    def __post_init__(self):
        if min(self.window_size, self.stride, self.min_window_size) < 1 or self.min_window_size > self.window_size:
            raise ConfigurationError("sizes and stride are at least 1, and the least size is at most the window's")


def render(turns: Column, config: WindowConfig = WindowConfig()) -> Column:
    line = lambda t: F.concat(F.lit("["), F.upper(t["speaker"]), F.lit("] "), t["text"]) if config.labels else t["text"]
    return F.array_join(F.transform(turns, line), config.delimiter)


def role_text(turns: Column, role: str, delimiter: str = "\n") -> Column:
    return F.array_join(F.transform(F.filter(turns, lambda t: t["speaker"] == role), lambda t: t["text"]), delimiter)


def build(turns: DataFrame, config: WindowConfig = WindowConfig()) -> DataFrame:
    """Windows of turns(conversation_id, ord, speaker, text): starts every `stride` turns, at most `window_size` long.

    A conversation's turns are gathered once, in order; a window is a slice of them. The gathering is
    the only exchange, and every later measure of a window is an expression over its slice.
    """
    gathered = turns.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("ord", "speaker", "text"))).alias("all"))
    n = F.size("all")
    starts = gathered.select("conversation_id", "all", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(config.stride))).alias("start"))
    size = F.least(F.lit(config.window_size), F.col("n") - F.col("start"))
    least = config.min_window_size if config.include_partial_tail else config.window_size
    cut = starts.withColumn("window_size", size).where(F.col("window_size") >= least).withColumn("turns", F.slice("all", F.col("start") + 1, F.col("window_size")))
    number = (F.col("start") / config.stride).cast("int")
    return cut.select(
        F.concat(F.col("conversation_id").cast("string"), F.lit("_win_"), number.cast("string")).alias("window_id"), "conversation_id", F.col("start").alias("start_index"),
        (F.col("start") + F.col("window_size") - 1).alias("end_index"), "window_size", F.lit(config.stride).alias("stride"), render(F.col("turns"), config).alias("window_text"), "turns",
    )


def measures(windows: DataFrame) -> DataFrame:
    """Characters, words, and what each speaker has of a window."""
    total = lambda f: F.aggregate("turns", F.lit(0), lambda a, t: a + f(t["text"]))
    count = lambda role: F.size(F.filter("turns", lambda t: t["speaker"] == role))
    speakers = F.array_distinct(F.transform("turns", lambda t: t["speaker"]))
    return windows.select(
        "window_id", "conversation_id", total(F.char_length).alias("total_chars"), total(lambda t: F.size(T.words(t))).alias("total_words"), count("customer").alias("customer_turns"), count("agent").alias("agent_turns"),
        count("system").alias("system_turns"), F.size(speakers).alias("speaker_count"), (count("customer") > 0).alias("has_customer"), (count("agent") > 0).alias("has_agent"),
        role_text(F.col("turns"), "customer").alias("customer_text"), role_text(F.col("turns"), "agent").alias("agent_text"),
    )


def coverage(turns: DataFrame, windows: DataFrame) -> DataFrame:
    """Per conversation: turns, those in some window, in none, in several, and the covered share."""
    hits = windows.select("conversation_id", F.explode(F.sequence("start_index", "end_index")).alias("i")).groupBy("conversation_id", "i").agg(F.count(F.lit(1)).alias("k"))
    covered = hits.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("covered"), F.count_if(F.col("k") > 1).alias("overlapping"))
    total = turns.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("total_turns"))
    out = total.join(covered, "conversation_id", "left").na.fill(0, ["covered", "overlapping"])
    return out.select("conversation_id", "total_turns", "covered", (F.col("total_turns") - F.col("covered")).alias("orphans"), "overlapping", (F.col("covered") / F.col("total_turns")).alias("coverage_ratio"))
