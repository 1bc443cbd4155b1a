"""Exact deduplication by a stateful stream. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dialoom.llm.common import work_path, written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null as empty. Texts of one byte a character take the fast way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digest(text: Column, bits: int = 256) -> Column:
    """SHA-256 in hex, or its first bits (a multiple of 4), which tests shorten to meet collisions."""
    return F.sha2(text, 256) if bits == 256 else F.substring(F.sha2(text, 256), 1, bits // 4)


class StreamingDedup:
    """Keyed state over a folder of Parquet files that can grow: digest -> copies, row that stays.

    State lives in RocksDB on the executors' disks, with snapshots in `checkpoint`; no watermark, so
    it never expires. For each digest it retains the largest doc_id (the stable identifier), the
    file and row of that document (the content locator) and the number of rows. `update()` takes in
    the files that came since the last call; `state()` is the newest entry of each digest;
    `resolve()` checks the whole bytes of every hit and gives one row per document.

    Null texts count as empty. Null doc_ids are smaller than any other. Rows with equal doc_id and
    text are told apart by file and row; only one is kept. A table without rows gives none; a folder without files needs `schema`. Texts of any length are compared whole. Columns
    other than those asked for are not read, whatever their names.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, bits: int = 256, schema=None):
        self.spark, self.path, self.id_col, self.text_col, self.bits = spark, path, id_col, text_col, bits
        self.at = checkpoint or work_path(spark, "dedup")
        known = schema or spark.read.parquet(path).schema
        self.schema = StructType([known[c] for c in dict.fromkeys((id_col, text_col))])  # a column named _metadata would hide the files' own

    def _rows(self, source: DataFrame) -> DataFrame:
        norm = ascii_lower(F.col(self.text_col))
        return source.select(
            F.col(self.id_col).alias("doc_id"), norm.alias("norm"), F.struct(F.col(self.id_col).alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("loc")
        ).withColumn("digest", digest(F.col("norm"), self.bits))

    def update(self) -> None:
        conf = self.spark.conf
        # A store is closed when its task has committed it: the state rests in the checkpoint, not on every executor's disk.
        wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
        before = {key: conf.get(key, None) for key in wanted}
        for key, value in wanted.items():
            conf.set(key, value)
        try:
            whole = self.path.rstrip("/")
            rows = self._rows(self.spark.readStream.schema(self.schema).parquet(f"{whole[:-1]}[{whole[-1]}]"))  # as a pattern, which may name a file or a folder
            state = rows.groupBy("digest").agg(F.max("loc").alias("keep"), F.count(F.lit(1)).alias("n"))
            at = self.at

            def keep(batch: DataFrame, number: int) -> None:  # a batch that is run again writes the same folder
                batch.write.mode("overwrite").parquet(f"{at}/entries/batch={number}")

            query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/stream").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)

    def state(self) -> DataFrame:
        entries = self.spark.read.schema("digest string, keep struct<doc_id: %s, file: string, row: bigint>, n bigint, batch int" % self.schema[self.id_col].dataType.simpleString()).option("basePath", f"{self.at}/entries").parquet(f"{self.at}/entries")
        return entries.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("last")).select("digest", "last.keep", "last.n")

    def resolve(self) -> DataFrame:
        rows = self._rows(self.spark.read.schema(self.schema).parquet(self.path))
        state = written(self.state(), "dedup-state")  # read again, so that the joins can split a digest with many rows
        # Every hit is checked by its whole text: of the rows of a digest, the least and the greatest text must be one.
        # The two are partly aggregated before any exchange, so a large group of copies sends one text per task.
        hits = rows.select("digest", "norm").join(state.where("n > 1").select("digest"), "digest").select(F.reverse("digest").alias("back"), "norm")
        torn = hits.groupBy("back").agg((F.min("norm") != F.max("norm")).alias("torn")).where("torn").select(F.reverse("back").alias("digest"))
        torn = written(torn, "dedup-torn")  # digests that differing texts share: none, unless SHA-256 is broken or cut short
        flagged = rows.drop("norm").join(state, "digest")
        if torn.limit(1).count():
            whole = rows.join(torn, "digest")
            groups = whole.groupBy("digest", "norm").agg(F.max("loc").alias("keep"), F.count(F.lit(1)).alias("n"))
            apart = whole.join(groups, ["digest", "norm"]).select("doc_id", "loc", F.sha2("norm", 256).alias("sha"), "keep", "n")
            flagged = flagged.join(torn, "digest", "left_anti").join(rows.select("loc", F.sha2("norm", 256).alias("sha")), "loc").select("doc_id", "loc", "sha", "keep", "n").unionByName(apart)
        else:
            flagged = flagged.withColumn("sha", F.col("digest"))
            if self.bits != 256:
                flagged = flagged.drop("sha").join(rows.select("loc", F.sha2("norm", 256).alias("sha")), "loc")
        return flagged.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("loc") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"))


def exact_dedup(spark: SparkSession, path: str, **options) -> DataFrame:
    """One pass over the files in path: update() then resolve()."""
    dedup = StreamingDedup(spark, path, **options)
    dedup.update()
    return dedup.resolve()
