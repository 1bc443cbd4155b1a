"""Fuzzy line deduplication by MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, discard, texts_of, written
from dialoom.llm.similar import similar_groups

#: Characters in a shingle, bands, and rows of a band.
SHINGLE, BANDS, ROWS = 8, 8, 3
BINS = BANDS * ROWS
#: UTF-16 units that are hashed at once.
BLOCK = 1 << 16
#: One for each doubling of 1 unit to SHINGLE.
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_EMPTY = np.uint32(0xFFFFFFFF)


def _hashes(units: np.ndarray) -> np.ndarray:
    """The hash of the shingle that starts at each UTF-16 unit, where one fits."""
    with np.errstate(over="ignore"):
        h, reach = units.astype(np.uint64), 1
        for factor in _FACTORS:  # 1, 2, 4 units at once, up to SHINGLE
            h = h[:-reach] + h[reach:] * factor
            reach *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def line_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines' shingles, repeats included, and the number of the line of each; a line shorter than a shingle is filled up with zeros and is one."""
    units = np.frombuffer("\n".join([x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]).encode("utf-16-le", "surrogatepass"), dtype="<u2")
    ends = np.r_[np.flatnonzero(units == 10), len(units)]
    counts = np.diff(ends, prepend=-1) - SHINGLE
    fits = np.ones(len(units) + 1, dtype=bool)
    for back in range(SHINGLE):  # the last starts of a line, and the line end
        fits[ends - back] = False
    return _hashes(units)[fits[: len(units) - SHINGLE + 1]], np.repeat(np.arange(len(lines)), counts)


def _blocks(lines: list[str]) -> Iterator[tuple[int, int, list[str]]]:
    """Lines by their numbers, about BLOCK characters at once; a longer line comes in pieces that overlap by less than a shingle."""
    start, held = 0, 0
    for k, line in enumerate(lines):
        if held and held + len(line) > BLOCK:
            yield start, k, lines[start:k]
            start, held = k, 0
        if len(line) > BLOCK:
            for at in range(0, len(line) - SHINGLE + 1, BLOCK):
                yield k, k + 1, [line[at : at + BLOCK + SHINGLE - 1]]
            start = k + 1
        else:
            held += len(line)
    if start < len(lines):
        yield start, len(lines), lines[start:]


def minima(lines: list[str]) -> np.ndarray:
    """(lines, BINS): one-permutation MinHash. A shingle's hash picks one of the bins and is a candidate for its minimum; a bin without any is empty."""
    least = np.full(len(lines) * BINS, _EMPTY)
    for start, _, some in _blocks(lines):
        h, of = line_shingles(some)
        at = (of + start) * BINS + ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(least, at, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    return least.reshape(-1, BINS)


def bands(least: np.ndarray) -> np.ndarray:
    """(lines, BANDS) longs: 16 bits of the minimum of each of a band's bins, 0 for an empty one.

    A band is the key of a bucket and a part of the sketch. Nothing is put into empty bins: two short lines share a
    band if all shingles that are least in its bins are common.
    """
    bits = np.zeros((len(least), BANDS, 4), dtype="<u2")
    bits[:, :, :ROWS] = np.where(least == _EMPTY, 0, np.maximum(least & np.uint32(0xFFFF), 1)).reshape(-1, BANDS, ROWS)
    return bits.view("<i8")[:, :, 0]


_BANDS = [f"b{k}" for k in range(BANDS)]


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, pos, id, other, norm, b0...): every line that is not blank, in one pass and without an exchange.

    norm is the line as compared, without white space at its ends and in lower case; id and other are the halves of
    its 128-bit hash; th hashes the whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, pos, lines = [], [], []
            for k, text in enumerate(texts_of(b.column(2))):
                for p, line in enumerate(text.lower().split("\n")):
                    if line := line.strip():
                        of.append(k)
                        pos.append(p)
                        lines.append(line)
            if not lines:
                continue
            ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), dtype="<i8").reshape(-1, 2)
            rows = b.select([0, 1]).take(pa.array(of))
            columns = [*rows.columns, pa.array(pos, pa.int32()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, bands(minima(lines)).T.copy())], names=["doc", "th", "pos", "id", "other", "norm", *_BANDS])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return arrow_map(rows, run, f"doc {kind}, th long, pos int, id long, other long, norm string, {', '.join(f'{k} long' for k in _BANDS)}")


def _told_apart(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The line table, and (id, n, b0...) of the different lines. Should two lines share an id, theirs become hashes of both halves."""

    def different(table: DataFrame) -> DataFrame:
        return written(table.groupBy("id").agg(F.count(F.lit(1)).alias("n"), (F.min("other") != F.max("other")).alias("torn"), *[F.min(k).alias(k) for k in _BANDS]), "lines-different")

    known = different(lines)
    torn = known.where("torn").select(F.col("id").alias("twice"))
    if torn.limit(1).count():
        apart = lines.join(torn, F.col("id") == F.col("twice"), "left")
        lines = written(apart.withColumn("id", F.when(F.col("twice").isNull(), F.col("id")).otherwise(F.xxhash64("id", "other"))).drop("twice"), "lines")
        known = different(lines)
    return lines, known


def near_lines(lines: DataFrame, known: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(node, component) of the different lines that a chain of similar ones joins to a smaller id.

    Lines that share a bucket of a band are candidates, each pair of them (see similar_groups).
    """
    members = known.select(F.explode(F.array(*[F.when(F.col(b) != 0, F.xxhash64(b, F.lit(k))) for k, b in enumerate(_BANDS)])).alias("key"), F.col("id").alias("node")).where("key is not null")

    def texts(needed: DataFrame) -> DataFrame:
        return lines.join(needed.hint("shuffle_hash"), lines.id == needed.node, "left_semi").groupBy(F.col("id").alias("node")).agg(F.min("norm").alias("text"))

    return similar_groups(members, known.select(F.col("id").alias("node"), *_BANDS), texts, line_shingles, threshold, "lines")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs with text rewritten, and n_lines and n_removed beside its columns.

    Of all lines that chains of similarity (Jaccard of character shingles, threshold or more) join, the one at the
    smallest (doc_id, hash of text, line number) stays; equal lines are similar. Lines are compared without white
    space at their ends and in lower case; blank lines stay. A line shorter than a shingle is one
    shingle; a line of any length is compared whole. Null texts count as empty and stay null; a document may end up empty but stays a row.
    A null doc_id is smaller than any other. Rows with equal doc_id and text are one document and are each returned alike. An empty table gives no rows.
    Other columns are passed through, also ones named like those used here.
    """
    lines, known = _told_apart(written(line_table(docs, id_col, text_col), "lines"))
    found = near_lines(lines, known, threshold)
    roots = found.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    grouped = known.select("id", "n").join(found.unionByName(roots).hint("shuffle_hash"), F.col("id") == F.col("node"), "left")
    many = grouped.where("n > 1 or component is not null").select("id", F.coalesce("component", "id").alias("component"))
    place = F.struct("doc", "th", "pos")
    places = written(lines.select("id", "doc", "th", "pos").join(many.hint("shuffle_hash"), "id").drop("id"), "lines-places")
    keepers = written(places.groupBy("component").agg(F.min(place).alias("keep")), "lines-keepers")
    drops = places.join(keepers, "component").where(~place.eqNullSafe(F.col("keep"))).select("doc", "th", "pos")
    drops = written(drops.distinct().groupBy("doc", "th").agg(F.collect_list("pos").alias("dropped")), "lines-drops")
    discard(lines, known, places, keepers)
    # Columns of docs are put away in a struct, so that none can clash.
    all_of = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    rows = all_of.withColumn("own", F.xxhash64(text)).join(drops.hint("shuffle_hash"), F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("th")), "left")
    # Only texts that lose lines are split. `parts` is used twice, as the optimizer would put a column used once into the lambda.
    rows = rows.withColumn("parts", F.when(F.col("dropped").isNotNull(), F.split(text, "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "dropped")
    kept = F.when(F.col("dropped").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("parts"), i)), "\n"))
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    same = [F.col(f"row.`{c}`").alias(c) if c != text_col else kept.alias(c) for c in docs.columns]
    return rows.select(*same, F.when(F.col("dropped").isNull(), ends + 1).otherwise(F.size("parts")).alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).alias("n_removed"))


def line_dedup_query(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
