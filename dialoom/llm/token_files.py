"""Training-order materialisation: fixed-stride shards of token ids in an order set by a keyed permutation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, bounded, discard, texts_of, work_path, written
from dialoom.llm.tokens import END_ID, TOKENIZER, encoder


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixing function (the SplitMix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Feistel:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the least even number of bits that hold n,
    walked along its cycle until the value is below n (four steps at the mean at most)."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [int(k) for k in _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), key & (1 << 64) - 1)]

    def _pass(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in keys:
            if back:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        y = self._pass(x.astype(np.uint64), keys, back)
        while (out := y >= self.n).any():
            y[out] = self._pass(y[out], keys, back)
        return y.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


@dataclass(frozen=True)
class Layout:
    """How shards lie on disk. A record is `tokens` ids of `width` bytes, little-endian, then the number of those that
    are not padding as four bytes; with the last of these, which is always zero, the record also ends as a line."""

    path: str
    sequences: int
    tokens: int
    width: int
    shard_sequences: int

    @property
    def stride(self) -> int:
        return self.tokens * self.width + 4

    def place(self, slot: int) -> tuple[int, int]:
        """The shard and the byte at which a slot's record starts: reading can go on from any slot."""
        return slot // self.shard_sequences, slot % self.shard_sequences * self.stride


SEQUENCE_SCHEMA = "part int, at long, n_tokens int, crc32 long, doc_ids array<long>, record binary"


def sequences(docs: DataFrame, tokens: int, width: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The ids of a partition's documents, each with the end id, as one stream cut into sequences; the last is padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, kind = encoder(tokenizer), TaskContext.get().partitionId(), np.dtype(f"<u{width}")
        size, at = tokens * width, 0
        held, count = bytearray(), 0  # what is not yet a whole sequence
        spans: list[tuple[int | None, int]] = []  # documents in it, each with its tokens
        rows: list[tuple] = []

        def cut(n: int) -> None:
            nonlocal at, count
            body = bytes(held[: n * width]).ljust(size, b"\0")
            del held[: n * width]
            docs_in, left = [], n
            while left:
                doc, k = spans[0]
                docs_in.append(doc)
                if k > left:
                    spans[0] = (doc, k - left)
                    left = 0
                else:
                    spans.pop(0)
                    left -= k
            record = body + n.to_bytes(4, "little")
            rows.append((part, at, n, zlib.crc32(record), docs_in, record))
            at, count = at + 1, count - n

        def batch() -> pa.RecordBatch:
            a, b, c, d, e, f = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int64()), pa.array(e, pa.list_(pa.int64())), pa.array(f, pa.binary())], names=["part", "at", "n_tokens", "crc32", "doc_ids", "record"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                ids = np.frombuffer(enc.encode(text) + END_ID.to_bytes(4, "little"), "<u4")
                if width == 2 and ids.max() >= 1 << 16:
                    raise ValueError("an id does not fit in 2 bytes; use width=4")
                held += ids.astype(kind).tobytes()
                spans.append((doc, len(ids)))
                count += len(ids)
                while count >= tokens:
                    cut(tokens)
                if len(rows) >= 512:
                    yield batch()
        if count:
            cut(count)
        if rows:
            yield batch()

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SEQUENCE_SCHEMA)


def materialise(docs: DataFrame, path: str, key: int, tokens: int = 2048, width: int = 2, shard_sequences: int = 4096, ranges: int = 2, **columns: str) -> tuple[Layout, DataFrame]:
    """Writes shards under path/shard=<k>/ and returns their layout and a row for each sequence.

    The sequences are written once to the shared folder, so that the permutation is over what is
    there whatever executor is lost. Each partition's number of sequences gives a dense index; the
    permutation gives its slot; a shard holds `shard_sequences` consecutive slots and is one task.
    Shards are written in `ranges` ranges of slots, each with a shuffle of its own, whose files go before the next; the staged
    records go in the end. Null texts count as empty; an empty table writes no shard. Rows that repeat are each written.
    A text of any length is written whole. Other columns are not read, whatever their names. What is at `path` is replaced.
    """
    spark = docs.sparkSession
    made = written(sequences(docs, tokens, width, **columns), "sequences", 200)
    counts = {r.part: r.n for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    layout = Layout(path, total, tokens, width, shard_sequences)
    starts = spark.sparkContext.broadcast(before)
    order = Feistel(max(total, 1), key)

    @F.pandas_udf("struct<index: long, slot: long>")
    def place(part, at):
        import pandas as pd

        index = part.map(starts.value).to_numpy(dtype=np.int64) + at.to_numpy()
        return pd.DataFrame({"index": index, "slot": order.slot(index)})

    placed = made.withColumn("to", place("part", "at")).select("to.index", "to.slot", "n_tokens", "crc32", "doc_ids", "record")
    shard = F.floor(F.col("slot") / shard_sequences).cast("int")
    rows = placed.drop("record").withColumn("shard", shard).withColumn("offset", F.col("slot") % shard_sequences * layout.stride)
    rows = written(rows, "sequence-rows")
    shards = max(1, -(-total // shard_sequences))
    # Without its last byte, a zero that the writer puts there as the line's end.
    lines = placed.select(F.expr("cast(substring(record, 1, length(record) - 1) as string)").alias("value"), "slot", shard.alias("shard"))
    edges = sorted({shards * r // ranges for r in range(ranges + 1)})
    with bounded(spark):
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            some = lines.where((F.col("shard") >= low) & (F.col("shard") < high)).withColumn("shard", F.col("shard") - low)
            some = some.repartitionById(high - low, F.col("shard")).withColumn("shard", F.col("shard") + low).sortWithinPartitions("shard", "slot")
            some.select("value", "shard").write.partitionBy("shard").option("lineSep", "\0").mode("append" if low else "overwrite").text(path)
    discard(made)
    return layout, rows


def read_records(spark: SparkSession, layout: Layout) -> DataFrame:
    """(slot, record) of all shards, as they lie on disk."""
    if not layout.sequences:
        return spark.createDataFrame([], "slot long, record binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(layout.path)
    shard = F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long")
    n = F.expr(f"cast(length / {layout.stride} as int)")
    return files.select(shard.alias("shard"), "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("at")).select(
        (F.col("shard") * layout.shard_sequences + F.col("at")).alias("slot"), F.expr(f"substring(content, at * {layout.stride} + 1, {layout.stride})").alias("record")
    )


def token_files_query(docs: DataFrame, key: int = 20240607) -> DataFrame:
    """A row per sequence; its checksum is of the bytes read back from the shards."""
    spark = docs.sparkSession
    layout, rows = materialise(docs, work_path(spark, "shards"), key)
    back = read_records(spark, layout).select("slot", F.crc32("record").alias("file_crc32"))
    return rows.join(back, "slot", "left").select("doc_ids", F.col("index").alias("sequence_index"), "slot", "shard", "offset", "n_tokens", "crc32", "file_crc32")
