"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once under spark.checkpoint.dir and read again, for plans that use it more than once. Survives lost executors."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="dialoom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/dialoom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, on whatever file system the path names."""
    where, system = _file(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of one small file, or None where there is none."""
    where, system = _file(spark, path)
    if not system.exists(where):
        return None
    row = spark.read.text(path, wholetext=True).first()  # no row for an empty file
    return row[0] if row else ""
