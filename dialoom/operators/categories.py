"""Categories: named rules that are kept, tried out on all windows, and applied to them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.errors import ValidationError
from dialoom.operators.search import NAME_LENGTH, RULE_LENGTH, within
from dialoom.operators.vectors import cosine
from dialoom.plans import rules as R
from dialoom.sources.working import read_text, write_text


@dataclass(frozen=True)
class Category:
    category_id: str
    name: str
    rule: str
    description: str = ""
    created_at: str = ""
    applied: bool = False
    match_count: int = 0
    conversation_count: int = 0
    apply_time_ms: float = 0.0


class CategoryStore:
    """Categories in one JSON file of a folder, and a table of matches for each that was applied.

    One writer at a time: the file is read before each change and written as a whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _all(self) -> dict[str, Category]:
        found = read_text(self.spark, f"{self.path}/categories.json")
        return {c["category_id"]: Category(**c) for c in json.loads(found)} if found else {}

    def _keep(self, found: dict[str, Category]) -> None:
        write_text(self.spark, f"{self.path}/categories.json", json.dumps([asdict(c) for c in found.values()], ensure_ascii=False, indent=2))

    def list(self) -> list[Category]:
        return sorted(self._all().values(), key=lambda c: c.name)

    def get(self, category_id: str) -> Category | None:
        return self._all().get(category_id)

    def create(self, name: str, rule: str, description: str = "") -> Category:
        """Names differ by more than case; the rule has to compile."""
        within("the length of a name", len(name), NAME_LENGTH)
        within("the length of a rule", len(rule), RULE_LENGTH)
        found = self._all()
        if any(c.name.lower() == name.lower() for c in found.values()):
            raise ValidationError(f"there is a category {name} already")
        key = f"cat_{uuid.uuid4().hex[:12]}"
        R.compile_rule(rule, key, name)
        found[key] = Category(key, name, rule, description, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
        self._keep(found)
        return found[key]

    def delete(self, category_id: str) -> bool:
        found = self._all()
        gone = found.pop(category_id, None)
        if gone is not None:
            self._keep(found)
        return gone is not None

    def apply(self, category_id: str, inputs: DataFrame) -> Category:
        """The category after its rule has met all inputs; its matches are written to a table."""
        found = self._all()
        if category_id not in found:
            raise ValidationError(f"there is no category {category_id}")
        start = time.monotonic()
        at = f"{self.path}/matches/{category_id}"
        matches(inputs, R.compile_rule(found[category_id].rule, category_id)).write.mode("overwrite").parquet(at)
        n = self.matches(category_id).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conversation_id").alias("c")).first()
        found[category_id] = replace(found[category_id], applied=True, match_count=n.n, conversation_count=n.c, apply_time_ms=round((time.monotonic() - start) * 1000, 2))
        self._keep(found)
        return found[category_id]

    def matches(self, category_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/matches/{category_id}")


def matches(inputs: DataFrame, rule: R.Rule) -> DataFrame:
    """(window_id, conversation_id, score, matched_text) of the windows that a rule matches; the text is that of the first piece of evidence with one."""
    out = R.evaluate(inputs, [rule]).where("matched")
    shown = F.filter("evidence", lambda e: e["matched"] & (F.coalesce(e["matched_text"], F.lit("")) != ""))
    return out.select(F.col("source_id").alias("window_id"), "conversation_id", "score", F.get(shown, F.lit(0))["matched_text"].alias("matched_text"))


def semantic_features(inputs: DataFrame, rule: R.Rule, vector_of: Callable[[str], list[float]], vec: str = "embedding", id_col: str = "source_id") -> DataFrame:
    """inputs with `features`: the cosine of each vector to the text that a semantic test refers to, under the test's field.

    Of two texts under one field the later counts. The references stand in the plan, as many as the rule has tests. Inputs without a vector score 0.
    """
    wanted = {t.field: str(t.value) for t in R.tests_of(rule.tree) if t.family == "semantic" and t.value}
    none = F.create_map().cast("map<string,double>")
    old = F.coalesce(F.col("features").cast("map<string,double>"), none) if "features" in inputs.columns else none
    if not wanted:
        return inputs.withColumn("features", old)
    pairs = [x for field, text in wanted.items() for x in (F.lit(field), F.coalesce(cosine(F.col(vec), F.array(*[F.lit(float(v)) for v in vector_of(text)])), F.lit(0.0)))]
    rest = F.map_filter(old, lambda k, _: ~k.isin(*wanted))
    return inputs.withColumn("features", F.map_concat(rest, F.create_map(*pairs)))


#: Bounds of coverage in per cent and of the share of conversations, and the points they give.
FAINT, MANY_FAINT, BROAD, NARROW, CLUSTERED = 0.05, 70, 80, 0.5, 0.1


def spread(matches_: DataFrame) -> DataFrame:
    """One row on matches(conversation_id, score): counts, and score statistics at four places by index.

    Scores between 0 and 1 are counted by their four places first, so a row for each of at most 10,001 values reaches the one task that ranks them.
    """
    totals = matches_.agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("conversation_id").alias("conversations"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("score") < FAINT).alias("faint"))
    counts = matches_.groupBy(F.round("score", 4).alias("s")).agg(F.count(F.lit(1)).alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
    # One row of totals: a broadcast of proven size.
    both = upto.join(F.broadcast(totals.select("matches").alias("t")))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("s")))
    scores = both.agg(F.min("s").alias("min_score"), F.max("s").alias("max_score"), at(F.floor(F.col("matches") / 2)).alias("median_score"), at(F.floor(F.col("matches") * 0.9)).alias("p90_score"))
    return totals.join(F.broadcast(scores))


def report(matches_: DataFrame, windows: int, conversations: int, families: int) -> DataFrame:
    """What a rule's matches look like beside the corpus: coverage, concentration, warnings, and a quality of 0 to 100."""
    percent = lambda a, b: a / F.lit(float(b)) * 100 if b else F.lit(0.0)
    s = spread(matches_).withColumns({"w": percent(F.col("matches"), windows), "c": percent(F.col("conversations"), conversations)})
    s = s.withColumn("ratio", F.coalesce(F.col("conversations") / F.nullif("matches", F.lit(0)), F.lit(0.0)))
    some, w, ratio, mean = F.col("matches") > 0, F.col("w"), F.col("ratio"), F.coalesce("mean_score", F.lit(-1.0))
    codes = F.array(
        F.when(some & (F.col("faint") / F.col("matches") * 100 > MANY_FAINT), "many faint scores"),
        F.when(w > BROAD, "too broad").when(some & (w < NARROW), "too narrow"),
        F.when(some & (ratio < CLUSTERED), "few conversations"),
        F.when(~some, "no matches"),
    )
    steps = lambda *pairs: F.coalesce(*[F.when(test, points) for test, points in pairs], F.lit(0))
    points = F.lit(50 + (5 if families >= 2 else 0)) + steps((w.between(1, 30), 20), (((w >= 0.5) & (w < 1)) | ((w > 30) & (w <= 50)), 10)) + steps((mean > 0.5, 15), (mean > 0.3, 10), (mean > 0.1, 5)) + steps((ratio > 0.3, 10), (ratio > 0.1, 5))
    points = F.when(~some, F.greatest(points - 30, F.lit(5))).otherwise(points)
    points = F.least(F.when(w > BROAD, F.greatest(points - 20, F.lit(10))).otherwise(points), F.lit(100))
    return s.select(
        "matches", "conversations", "min_score", "max_score", "mean_score", "median_score", "p90_score", F.round("w", 2).alias("window_coverage"), F.round("c", 2).alias("conversation_coverage"),
        F.round("ratio", 4).alias("concentration"), F.filter(codes, lambda x: x.isNotNull()).alias("warnings"), points.alias("quality"),
    )
