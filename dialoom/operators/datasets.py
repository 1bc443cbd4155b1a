"""Checks and splits of labelled datasets, and previews of categories."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import categories
from dialoom.operators.vectors import cosine
from dialoom.sources.working import write_text


def hash_rank(df: DataFrame, group: str, key: str, seed: int, name: str) -> DataFrame:
    """df with each row's place within its group, in an order set by a hash.

    A group is cut into 4,096 ranges of hashes, so that no task orders a whole group, however large; the ranges before a row's own are counted.
    """
    h = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_b", F.shiftright("_h", 52))
    n = h.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_k"))
    before = n.withColumn("_before", F.sum("_k").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")).select(F.col(group).alias("_g"), F.col("_b").alias("_c"), "_before")
    own = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", key))
    return h.withColumn("_own", own).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c"))).withColumn(name, F.col("_before") + F.col("_own")).drop("_h", "_b", "_own", "_before", "_g", "_c")


def split(df: DataFrame, label: str, key: str, ratios: tuple[float, float] = (0.7, 0.15), seed: int = 42) -> DataFrame:
    """df with `split`: train, val or test, by shares of each label in an order set by a hash."""
    n = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    rows = hash_rank(df, label, key, seed, "_at").join(n, F.col(label).eqNullSafe(F.col("_l")))
    a, b = F.rint(F.col("_n") * ratios[0]), F.rint(F.col("_n") * ratios[1])
    return rows.withColumn("split", F.when(F.col("_at") <= a, "train").when(F.col("_at") <= a + b, "val").otherwise("test")).drop("_at", "_n", "_l")


def split_counts(rows: DataFrame, label: str) -> DataFrame:
    """(label, split, n, share of the split): the distribution of each split."""
    n = rows.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("split").agg(F.count(F.lit(1)).alias("t"))
    return n.join(total, "split").select(label, "split", "n", F.round(F.col("n") / F.col("t"), 4).alias("share"))


def write_splits(rows: DataFrame, label: str, path: str, **settings) -> dict:
    """JSON lines under path/split=…, and path/manifest.json with the counts and settings, which are returned."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy("split").json(path)
    counts = split_counts(spark.read.schema(rows.schema).json(path), label).collect()  # a row per label and split
    manifest = {"total_count": sum(r["n"] for r in counts)} | {f"{s}_count": sum(r["n"] for r in counts if r["split"] == s) for s in ("train", "val", "test")}
    manifest["distribution"] = {str(k): sum(r["n"] for r in counts if r[label] == k) for k in dict.fromkeys(r[label] for r in counts)}
    write_text(spark, f"{path.rstrip('/')}/manifest.json", json.dumps(manifest | settings, ensure_ascii=False, indent=2))
    return manifest | settings


def majority(df: DataFrame, label: str) -> DataFrame:
    """The commonest label, its share, and the macro F1 of always guessing it."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    s = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority_label"), F.count(F.lit(1)).alias("labels"))
    share = F.col("most") / F.col("total")
    return s.select("majority_label", F.round(share, 4).alias("accuracy"), F.round(2 * share / (1 + share) / F.col("labels"), 4).alias("macro_f1"))


def exclusivity(df: DataFrame, label: str, text: str, least: int = 5, top: int = 20) -> DataFrame:
    """The words most bound to each label: share of a word's uses that fall to the label, for words used `least` times."""
    words = df.select(F.col(label).alias("label"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\b\w+\b"), 0)).alias("word")).where(F.char_length("word") > 2)
    counts = words.groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("word").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    ratio = counts.join(total, "word").withColumn("exclusivity", F.col("n") / F.col("total"))
    order = Window.partitionBy("label").orderBy(F.desc("exclusivity"), F.desc("n"), "word")
    return ratio.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("label", "rank", "word", F.col("n").alias("uses"), F.round("exclusivity", 6).alias("exclusivity"))


def separation(centroids: DataFrame) -> DataFrame:
    """Cosine of each two labels' centroids; a row per label goes in."""
    a, b = (centroids.select(F.col("label").alias(x), F.col("vector").alias(f"{x}_v")) for x in ("a", "b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("a_v"), F.col("b_v")), 6).alias("cosine"))


def cohesion(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Mean cosine of a label's vectors to its centroid. rows(label, vector)."""
    c = centroids.select("label", F.col("vector").alias("c"))
    return rows.join(F.broadcast(c), "label").groupBy("label").agg(F.round(F.avg(cosine(F.col("vector"), F.col("c"))), 6).alias("cohesion"), F.count(F.lit(1)).alias("n"))


def few_shot_usage(df: DataFrame, key: str, examples: str) -> DataFrame:
    """How often each example was used, and by how many rows."""
    return df.select(key, F.explode(examples).alias("example_id")).groupBy("example_id").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct(key).alias("rows"))


def backfill(df: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """df with nulls of a column filled from patch(key, column), and what became of each row."""
    p = patch.select(key, F.col(column).alias("_new"))
    state = F.when(F.col(column).isNotNull(), "kept").when(F.col("_new").isNotNull(), "patched").otherwise("missing")
    return df.join(p, key, "left").withColumn("patch_state", state).withColumn(column, F.coalesce(column, "_new")).drop("_new")


def compare(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def speaker_by_tags(text: Column) -> Column:
    """The speaker with more tags in a window's text; none: null; as many: customer."""
    count = lambda tag: F.regexp_count(F.lower(text), F.lit(rf"\[{tag}\]"))
    return F.when(count("customer") + count("agent") == 0, F.lit(None)).when(count("customer") >= count("agent"), "customer").otherwise("agent")


def preview(matches: DataFrame, total: int) -> DataFrame:
    """Of matches(conversation_id, score): how many, in how many conversations, and the spread of scores by index, at four places."""
    return categories.spread(matches).withColumn("coverage_percent", F.round(F.col("matches") / F.lit(float(max(total, 1))) * 100, 2)).drop("faint")


#: Words that tell nothing of a label, in Portuguese.
STOP_WORDS = """
que com para por uma não nao são tem mais como seu sua esse essa isso está pode ser ter foi ele ela dos das nos nas num uma uns umas meu minha seu sua
este esta isto aqui ali lhe voce você muito bem sim tudo todo toda todos todas também tambem sobre entre depois antes ainda quando onde qual quais quem
porque então entao apenas cada mesmo mesma outro outra outros outras agora aquele aquela seus suas dele dela deles delas nosso nossa nossos nossas vou
vai vamos estou estamos
""".split()


def label_words(df: DataFrame, label: str, text: str, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(label, word, n): words of three letters or more that are no stop words; speaker tags do not count."""
    body = F.regexp_replace(F.lower(F.col(text)), r"\[(customer|agent)\]", "")
    words = df.select(F.col(label).alias("label"), F.explode(F.regexp_extract_all(body, F.lit(r"(?U)\b\w+\b"), 0)).alias("word")).where(F.char_length("word") > 2)
    return words.where(~F.col("word").isin(*stop)).groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))


def discrimination(words: DataFrame, least: int = 5, common: int = 100, top: int = 10) -> DataFrame:
    """(label, exclusivity): how much commoner a label's words are in it than everywhere, on the mean of its `top` commonest; none: 0.

    Of the `common` commonest words of a label those count that occur `least` times in all; equals in order of the word.
    """
    per_label = words.groupBy("label").agg(F.sum("n").alias("in_label"))
    per_word = words.groupBy("word").agg(F.sum("n").alias("uses"))
    # One row of totals: a broadcast of proven size.
    whole = words.agg(F.sum("n").alias("whole"))
    order = lambda: Window.partitionBy("label").orderBy(F.desc("n"), "word")
    best = words.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= common).join(per_word, "word").where(F.col("uses") >= least)
    best = best.withColumn("place", F.row_number().over(order())).where(F.col("place") <= top)
    score = (F.col("n") / F.col("in_label")) / (F.col("uses") / F.col("whole"))
    found = best.join(per_label, "label").join(F.broadcast(whole)).groupBy("label").agg(F.avg(score).alias("exclusivity"))
    return per_label.select("label").join(found, "label", "left").fillna(0.0, ["exclusivity"])


def overlap(words: DataFrame, top: int = 20, labels: int = 3) -> DataFrame:
    """One row: of the labels' `top` commonest words, how many there are, how many occur in `labels` labels or more, and their share."""
    order = Window.partitionBy("label").orderBy(F.desc("n"), "word")
    most = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    spread = words.groupBy("word").agg(F.count(F.lit(1)).alias("in_labels"))
    out = most.join(spread, "word").agg(F.count(F.lit(1)).alias("top_words"), F.count_if(F.col("in_labels") >= labels).alias("shared"))
    return out.withColumn("overlap", F.coalesce(F.round(F.col("shared") / F.nullif("top_words", F.lit(0)), 4), F.lit(0.0)))


def lexical_difficulty(exclusivity: Column, share: Column) -> Column:
    """How hard labels are to tell by their words: easy, rather easy, hard or mixed, from fixed cut-offs."""
    return F.when((exclusivity > 5) & (share < 0.2), "easy").when((exclusivity > 3) & (share < 0.3), "rather easy").when((exclusivity < 2) & (share > 0.5), "hard").otherwise("mixed")


def vector_difficulty(between: Column, ratio: Column) -> Column:
    """How hard labels are to tell by their vectors, from the mean cosine of centroids and the ratio of separation, by fixed cut-offs."""
    return F.when(between > 0.9, "alike").when(between > 0.8, "hard").when(between > 0.6, "moderate").when((ratio > 2) & (between < 0.5), "easy").otherwise("separated")


def plan(spark: SparkSession, total: int, shares: dict[str, float], sentiments: dict[str, dict[str, float]], sectors: list[str], personas: list[str], start_id: int = 0, seed: int = 42) -> DataFrame:
    """Conversations to write: (conversation_id, intent, sector, persona, sentiment). Each intent has its share of the total, the last one the rest.

    Sentiments are drawn by the weights of the intent ("" for intents without their own), sectors and personas evenly, all from hashes of the number, so that every run gives the same rows.
    """
    names, left, rows = list(shares), max(total, 0), []
    for name in names:
        n = left if name == names[-1] else round(max(total, 0) * shares[name])
        rows.append((name, max(total, 0) - left, n))
        left -= n
    quotas = spark.createDataFrame(rows, "intent string, first bigint, n bigint").where("n > 0")
    each = quotas.select("intent", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("i"))
    u = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "i"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    pick = lambda items, what: F.get(F.array(*[F.lit(x) for x in items]), F.floor(u(what) * len(items)).cast("int"))

    def weighted(weights: dict[str, float]) -> Column:
        whole, upto, cuts = sum(weights.values()), 0.0, []
        for name, w in weights.items():
            upto += w / whole
            cuts.append(F.when(u("sentiment") < upto, F.lit(name)))
        return F.coalesce(*cuts, F.lit(list(weights)[-1]))

    own = [F.when(F.col("intent") == k, weighted(w)) for k, w in sentiments.items() if k]
    sentiment = F.coalesce(*own, weighted(sentiments[""]) if "" in sentiments else F.lit(None))
    number = F.format_string("conv_synth_%05d", F.col("i") + start_id)
    return each.select(number.alias("conversation_id"), "intent", pick(sectors, "sector").alias("sector"), pick(personas, "persona").alias("persona"), sentiment.alias("sentiment"))


def class_words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("terms", T.tokens(F.col(text)))


def draw(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, in an order set by a hash."""
    return hash_rank(df, group, key, seed, "_n").where(F.col("_n") <= n).drop("_n")


def turn_counts(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Log-normal turn counts (ln 7.5, 0.4), held to 4..20, even."""
    n = F.greatest(F.lit(4), F.least(F.lit(20), F.rint(F.exp(F.log(F.lit(7.5)) + 0.4 * F.randn(seed))).cast("int")))
    return rows.withColumn("turn_count", n + n % 2)


def summary(conversations: DataFrame, group: str) -> DataFrame:
    """conversations(conversation_id, group, turns): counts by group, most first."""
    return conversations.groupBy(group).agg(F.count(F.lit(1)).alias("conversations"), F.round(F.avg("turns"), 4).alias("avg_turns")).orderBy(F.desc("conversations"), group)


def facet(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
