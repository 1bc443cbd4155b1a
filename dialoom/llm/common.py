"""What several operators share: the shared folder, written tables, Arrow batches and graph components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python. Texts can be long, so this is small.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set here only where it is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="dialoom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark)}/dialoom/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def bounded(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """While it holds, an Arrow batch has so many rows and 16 MB at most, which bounds a Python worker's memory, and
    a query's shuffle files go when it ends. Settings are put back afterwards."""
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Working tables are read once or twice: little effort goes into their size. Most columns are hashes, for which a dictionary is vain.
_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20)}


def written(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with bounded(spark, rows):
        df.write.options(**_FILES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def collected(df: DataFrame) -> list:
    """The rows of a small report or model."""
    with bounded(df.sparkSession):
        return df.collect()


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table._written
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def each_utf8(column: pa.Array) -> Iterator[bytes]:
    """utf8_of, one at a time: only one text is held besides the batch."""
    for text in column:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal integer keys, from batches sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if rest:
            last = rest[-1]
            new[0] = any(last.column(k)[last.num_rows - 1].as_py() != c[0] for k, c in zip(keys, columns, strict=True))
        else:
            new[0] = False
        starts = np.flatnonzero(new)
        if not len(starts):
            rest.append(batch)
            continue
        cut = int(starts[-1])
        if cut:
            rest.append(batch.slice(0, cut))
        yield pa.Table.from_batches(rest)
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def run_ids(columns: list[np.ndarray]) -> np.ndarray:
    """The number of its run, for each row."""
    new = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable, for indexes below n and links a-b: label spreading with pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, old[a], low)
        np.minimum.at(label, old[b], low)
        while not np.array_equal(jump := label[label], label):
            label = jump
        if np.array_equal(old, label):
            break
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links(u, v) except those that are their own component.

    Each round takes every node's smallest neighbour below it as its parent, turns any other link
    of the node into one between that neighbour and the parent, and replaces parents by theirs.
    Tables are written between rounds, so that both sides of each join are dealt out by an exchange
    that adaptive execution can split: a node with a third of all links lands in no single task.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = written(links, name)
    while True:
        last, parent = links, written(links.groupBy("u").agg(F.min("v").alias("p")), f"{name}-parent")
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("g"))
        jumped = parent.join(up, "p", "left").select("u", F.coalesce("g", "p").alias("v"), F.col("g").isNotNull().alias("moved"))
        others = links.join(parent, "u").where("v <> p").select(F.greatest("v", "p").alias("u"), F.least("v", "p").alias("v"), F.lit(True).alias("moved"))
        step = written(jumped.unionByName(others).groupBy("u", "v").agg(F.max("moved").alias("moved")), name)
        discard(last, parent)
        links = step.select("u", "v")
        links._written = step._written
        if not step.where("moved").limit(1).count():
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to as many tasks as exchanges have: for work that costs more than its bytes show."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)
