"""Removal of repeated passages, found by a suffix order that is built column by column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.column_bwt import repeated_suffixes
from dialoom.llm.common import arrow_map, dealt, discard, runs, utf8_of, written

#: Windows in a segment at most, bytes looked at together, and members of a part of a shard.
MOST, BLOCK, PART = 128, 1 << 21, 512
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """Hashes of substrings from running sums: a polynomial modulo 2**64."""

    def __init__(self, most: int):
        with np.errstate(over="ignore"):
            self.up, self.down = [], []
            for base in _BASES:
                inverse = pow(base, -1, 1 << 64)
                for powers, x in ((self.up, base), (self.down, inverse)):
                    p = np.full(most + 1, x, dtype=np.uint64)
                    p[0] = 1
                    powers.append(np.cumprod(p))

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[which][: len(data)])))

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((sums[end] - sums[start]) * self.up[which][start])


def segments(data: np.ndarray, ends: np.ndarray, size: int, gram: int, hashes: _Hashes):
    """(key, whole, start, windows, twice) of texts laid end to end.

    A segment is a run of windows (strings of `size` bytes that start one after the other in one text)
    with the same least hash of a `gram`-byte string in them: its key. Equal windows have equal keys, and
    each window lies in one segment. whole hashes all its bytes; twice says whether the least occurs in
    more than one place, without which no two windows of the segment can be equal.
    """
    n, span = len(data), size - gram + 1
    if n < size:
        return None
    sums = hashes.sums(data, 0)
    at = np.arange(n - gram + 1)
    h = hashes.of(sums, at, at + gram, 0)
    least, have = h, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(least)]
    valid = np.arange(len(least)) + size <= ends[text]
    first = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]
    begin = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    first |= (np.arange(len(least)) - begin[run]) % MOST == 0
    begin = np.flatnonzero(first)
    stop = np.r_[begin[1:], len(least)]
    begin, stop = begin[valid[begin]], stop[valid[begin]]
    if not len(begin):
        return None
    # The valid windows of a text come first, so that a run is cut where they end.
    stop = np.minimum(stop, ends[text[begin]] - size + 1)
    views = np.lib.stride_tricks.sliding_window_view(h, span)
    twice = np.empty(len(begin), dtype=bool)
    for i in range(0, len(begin), 4096):
        s, e = begin[i : i + 4096], stop[i : i + 4096] - 1
        twice[i : i + 4096] = views[s].argmin(axis=1) + s != views[e].argmin(axis=1) + e
    other = hashes.sums(data, 1)
    whole = hashes.of(other, begin, stop + size - 1, 1) ^ _mix((stop - begin).astype(np.uint64))
    return least[begin].view(np.int64), whole.view(np.int64), begin, stop - begin, twice


SEGMENT = "key long, whole long, th long, start long, windows long, twice boolean"


def _segment_rows(texts: DataFrame, size: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(BLOCK + size)
        for b in batches:
            block, held = [], 0  # (text hash, start in the text, bytes)
            for th, text in zip(b.column(0).to_pylist(), utf8_of(b.column(1)), strict=True):
                for at in range(0, max(1, len(text) - size + 1), BLOCK // 2):  # a long text in pieces; each window lies in one
                    piece = text[at : at + BLOCK // 2 + size - 1]
                    if len(piece) < size:
                        continue
                    if held + len(piece) > BLOCK:
                        yield from found(block, hashes)
                        block, held = [], 0
                    block.append((th, at, piece))
                    held += len(piece)
            yield from found(block, hashes)

    def found(block, hashes: _Hashes) -> Iterator[pa.RecordBatch]:
        if not block:
            return
        sizes = np.array([len(p) for _, _, p in block])
        ends = np.cumsum(sizes)
        got = segments(np.frombuffer(b"".join(p for _, _, p in block), dtype=np.uint8), ends, size, gram, hashes)
        if got is None:
            return
        key, whole, begin, windows, twice = got
        text = np.searchsorted(ends, begin, side="right")
        th, base = np.array([t for t, _, _ in block]), np.array([a for _, a, _ in block])
        start = begin - (ends - sizes)[text] + base[text]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, whole, th[text], start, windows, twice)], names=[x.split()[0] for x in SEGMENT.split(", ")])

    return arrow_map(texts.select("th", "text"), run, SEGMENT)


def may_repeat(strings: list[bytes], keys: np.ndarray, size: int, gram: int, hashes: _Hashes) -> np.ndarray:
    """Which segments can have a window in common with another of the same key. Exact: it rules out only what cannot.

    Equal windows hold the key's string at the same offset, so what is beside it reaches half of the window's other bytes
    to the left or to the right: one of these two sides must be there in another segment. Where a key's string stands in a
    segment more than once, all segments of the key stay.
    """
    side = (size - gram) // 2
    sizes = np.array([len(x) for x in strings])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    sums = hashes.sums(data, 0)
    at = np.arange(len(data) - gram + 1)
    of = np.repeat(np.arange(len(strings)), sizes)[: len(at)]
    fits = at + gram <= ends[of]
    at, of = at[fits], of[fits]
    h = hashes.of(sums, at, at + gram, 0)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    least = np.flatnonzero(h == np.minimum.reduceat(h, first)[of])
    times = np.bincount(of[least], minlength=len(strings))
    place = at[least[np.r_[True, of[least][1:] != of[least][:-1]]]]
    stay = np.isin(keys, keys[times > 1])
    with np.errstate(over="ignore"):
        own = _mix(keys.view(np.uint64))
    for low, high in ((place - side, place), (place + gram, place + gram + side)):
        there = np.flatnonzero((low >= ends - sizes) & (high <= ends))
        x = hashes.of(sums, low[there], high[there], 0) ^ own[there]
        _, number, count = np.unique(x, return_inverse=True, return_counts=True)
        stay[there[count[number] > 1]] = True
    return stay


def _compare(parts: DataFrame, size: int, gram: int, most: int = 1 << 17) -> DataFrame:
    """(key, whole, a, b): runs of windows of a segment that occur elsewhere in its unit, by the suffix order of the unit's segments."""
    keys = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(BLOCK)
        for t in runs(batches, keys):
            # Whole units together, up to about `most` bytes: equal windows have equal keys, so strangers do no harm.
            cells = [t.column(k).to_numpy() for k in keys]
            new = np.zeros(t.num_rows, dtype=bool)
            for c in cells:
                new[1:] |= c[1:] != c[:-1]
            data = t.column("bytes").to_pylist()
            sizes = np.array([len(x) for x in data])
            edges, start, total = np.r_[np.flatnonzero(new), t.num_rows], 0, np.concatenate(([0], np.cumsum(sizes)))
            for k, edge in enumerate(edges):
                if k + 1 < len(edges) and total[edges[k + 1]] - total[start] <= most:
                    continue
                yield from compared(t.slice(start, edge - start), data[start:edge], hashes)
                start = edge

    def compared(t: pa.Table, data: list[bytes], hashes: _Hashes) -> Iterator[pa.RecordBatch]:
        # A segment of a shard in parts is in several units; two units in one collection may hold the same segment.
        ids = list(zip(t.column("key").to_pylist(), t.column("whole").to_pylist(), strict=True))
        seen: dict[tuple[int, int], int] = {}
        for k, x in enumerate(ids):
            seen.setdefault(x, k)
        chosen = list(seen.values())
        if sum(len(data[k]) for k in chosen) < BLOCK:
            stay = may_repeat([data[k] for k in chosen], np.array([ids[k][0] for k in chosen]), size, gram, hashes)
            chosen = [k for k, x in zip(chosen, stay.tolist(), strict=True) if x]
        flags = repeated_suffixes([data[k] for k in chosen], size)
        offsets = np.concatenate(([0], np.cumsum([len(data[k]) for k in chosen])))
        edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # no suffix near a string's end is that long, so runs end within it
        of = np.searchsorted(offsets, a, side="right") - 1
        if len(a):
            key, whole = (np.array([ids[chosen[k]][c] for k in of]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(whole), pa.array(a - offsets[of]), pa.array(b - offsets[of])], names=["key", "whole", "a", "b"])

    return arrow_map(dealt(parts, *keys).sortWithinPartitions(*keys), run, "key long, whole long, a long, b long")


def repeated_ranges(texts: DataFrame, size: int = 200, gram: int = 80) -> DataFrame:
    """(th, ranges): for each text hash, the byte ranges that strings of `size` bytes which also start elsewhere cover.

    Equal windows meet under their key. Segments that occur twice as a whole are all repeated. Where differing segments
    share a key, one copy of each goes to the suffix order; a key with more than PART of them is cut into parts,
    and every two parts meet in a unit of their own.
    """
    rows = written(_segment_rows(texts, size, gram), "passages-windows")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"), F.max("twice").alias("twice"))
    live = written(keys.where("n > 1 or twice").select("key", ((F.col("low") != F.col("high")) | F.col("twice")).alias("mixed")), "passages-keys")
    place = F.shiftleft("start", 9).bitwiseOR(F.col("windows")).alias("place")  # windows are at most MOST
    met = written(rows.select("key", "whole", "th", place).join(live, "key"), "passages-met")  # apart from the counts, so that a common key's rows can be split
    there = written(met.groupBy("key", "whole", "th", "place", "mixed").agg(F.count(F.lit(1)).alias("n")), "passages-segments")
    discard(rows, met, live)
    different = written(there.groupBy("key", "whole", "mixed").agg(F.sum("n").alias("n"), F.min(F.struct("th", "place")).alias("one")), "passages-different")
    twice = different.where("n > 1").select("key", "whole", F.lit(0).cast("long").alias("a"), F.col("one.place").bitwiseAND(511).alias("b"))

    # The bytes of one copy of each segment whose key others share.
    asked = different.where("mixed").select("key", "whole", F.col("one.th").alias("th"), F.col("one.place").alias("place"))
    sizes = written(asked.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "passages-sizes")
    lists = written(asked.groupBy("th").agg(F.collect_list(F.struct("key", "whole", "place")).alias("asked")), "passages-asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, wanted in zip(utf8_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                got = [(w["key"], w["whole"], text[w["place"] >> 9 : (w["place"] >> 9) + (w["place"] & 511) + size - 1]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], names=["key", "whole", "bytes"])

    texts_of_lists = texts.join(lists, "th").groupBy(F.col("th").bitwiseXOR(F.lit(1)).alias("t")).agg(F.max(F.struct("text", "asked")).alias("one")).select("one.text", "one.asked")
    copies = written(arrow_map(texts_of_lists, cut, "key long, whole long, bytes binary"), "passages-bytes")
    parts = F.ceil(F.col("k") / PART).cast("int")
    own = F.pmod(F.xxhash64("whole", F.lit(3)), parts).cast("int")
    units = copies.join(sizes, "key").select("key", "whole", "bytes", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    units = units.select("key", "whole", "bytes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    marks = written(_compare(units, size, gram).unionByName(twice).distinct(), "passages-marks")
    discard(different, copies, sizes, lists)
    start = F.shiftright("place", 9)
    covered = there.select("key", "whole", "th", "place").join(marks, ["key", "whole"]).select("th", (start + F.col("a")).alias("a"), (start + F.col("b") + size - 1).alias("b"))
    return covered.groupBy("th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def remove_passages(docs: DataFrame, size: int = 200, gram: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each row of docs: kept is what is left, as bytes; spans are the removed runs.

    A byte goes if a string of `size` bytes that covers it also starts anywhere else, in the same document too; on
    the input, not on what is left. Null texts count as empty; texts shorter than `size` lose nothing. Rows with equal
    texts have equal results, and each is the other's repetition. Texts are told apart by a 64-bit hash.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    ranges = written(repeated_ranges(rows, size, gram), "passages-ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, body, found in zip(b.column(0).to_pylist(), utf8_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for x in found or ():
                    if spans and x["a"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x["b"])
                    else:
                        spans.append([x["a"], x["b"]])
                left = b"".join(body[p:q] for p, q in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(body)], strict=True))
                out.append((doc, len(body), len(body) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
            c = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    joined = rows.join(ranges, "th", "left").select("doc_id", "text", "ranges")
    return arrow_map(joined, cut, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string, kept binary")


def passages_query(docs: DataFrame) -> DataFrame:
    return remove_passages(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
