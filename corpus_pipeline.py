"""From raw documents to packed training sequences, in five stages.

Every stage reads the columns of `documents` only, whatever others there are and whatever their names. Null texts count
as empty; a null id comes before all others in line dedup and after them in near-dedup. Rows that are equal in all
columns are scored, cleaned and drawn alike, and near-dedup leaves one of them. A table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import line_dedup, mixing, near_documents, packing, quality
from dialoom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    docs = docs.select(COLUMNS)  # other columns could clash with those of the join
    scored = quality.quality(docs, _labels(spark, sf_dir))
    rejected = scored.where("predicted = 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    return docs.join(rejected, docs.doc_id.eqNullSafe(F.col("id")) & (_text_hash() == F.col("hash")), "left_anti").select(COLUMNS)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat, exactly or nearly; n_chars follows."""
    return line_dedup.line_dedup(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): that with the smallest doc_id; rows with a null doc_id come last."""
    return near_documents.one_of_each(docs.select(COLUMNS)).select(COLUMNS)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: not at all, once or several times."""
    docs = docs.select(COLUMNS)
    rated, _ = mixing.mix(docs, mixing.language_labels(docs, _labels(spark, sf_dir)))
    other = rated.where("copies <> 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "copies").distinct()
    counted = docs.join(other, docs.doc_id.eqNullSafe(F.col("id")) & (_text_hash() == F.col("hash")), "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return counted.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies"))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs.select(COLUMNS), packing.Limits(tokens=2048, segments=256, loss=2048))


STAGES = [
    ("quality", good_documents),
    ("line dedup", new_lines),
    ("near-dedup", different_documents),
    ("mixing", mixed_documents),
    ("packing", packed),
]
#: The trained classifier, the fitted rates and the tokenizer are beyond SQL. Tests hold near-dedup and line dedup against plain Python; of the other stages they check properties only, and not run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
