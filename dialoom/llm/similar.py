"""Groups of texts whose sets of shingles are similar, from buckets of candidates: every pair of a bucket counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, components, dealt, discard, local_components, run_ids, runs, written

#: Members of a block, about, and members of a large bucket that all of its blocks hold.
PART, PIVOTS = 256, 16
#: Members up to which units are compared many at once, and shingles that a matrix of larger ones holds at once.
SMALL, COLUMNS = 12, 8192
#: Bits of a shingle's hash that give way to the number of its text.
_BITS = 12
_KEEP = np.uint64(~((1 << _BITS) - 1) & (1 << 64) - 1)

#: Texts to their shingles' hashes and the number of the text each is of, in order; each text has one at least.
Shingles = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (hash, text) in order; a hash keeps its upper 52 bits, so that one sort of integers does."""
    packed = np.sort((h & _KEEP) | of.astype(np.uint64))
    packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    return packed >> np.uint64(_BITS), (packed & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def _near(both: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return both >= threshold * (a + b - both) - 1e-9


def similar_pairs(h: np.ndarray, of: np.ndarray, asks: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of texts, i in asks and j in rows, whose sets have a Jaccard similarity of threshold or more: by matrix products."""
    n = int(of[-1]) + 1
    if n > 1 << _BITS:
        raise ValueError("a unit has too many texts")
    h, of = _distinct(h, of)
    sizes = np.bincount(of, minlength=n)
    first = np.r_[True, h[1:] != h[:-1]]
    start = np.flatnonzero(first)
    count = np.diff(np.r_[start, len(h)])
    often = count > 1  # others are in no two sets
    column = np.repeat(np.cumsum(often) - 1, count)
    shared = np.repeat(often, count)
    column, of = column[shared], of[shared]
    total = int(often.sum())
    both = np.zeros((len(asks), len(rows)))
    for a in range(0, total, COLUMNS):
        low, high = np.searchsorted(column, [a, a + COLUMNS])
        m = np.zeros((n, min(COLUMNS, total - a)), dtype=np.float32)
        m[of[low:high], column[low:high] - a] = 1
        both += m[asks] @ m[rows].T
    i, j = np.nonzero(_near(both, sizes[asks][:, None], sizes[rows][None, :], threshold))
    return asks[i], rows[j]


def small_pairs(h: np.ndarray, of: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The similar pairs within units of at most SMALL texts, many units at once: unit[of] tells whose a text is."""
    with np.errstate(over="ignore"):
        h = h ^ ((unit[of].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    h, of = _distinct(h, of)
    sizes = np.bincount(of, minlength=len(unit))
    codes = []
    for d in range(1, SMALL):
        here = np.flatnonzero(h[d:] == h[:-d])
        if not len(here):
            break
        codes.append(of[here] << _BITS | of[here + d])
    if not codes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code, both = np.unique(np.concatenate(codes), return_counts=True)
    i, j = code >> _BITS, code & (1 << _BITS) - 1
    near = _near(both, sizes[i], sizes[j], threshold) & (unit[i] == unit[j])
    return i[near], j[near]


_UNIT = ["key", "i", "j"]


def _edges(unit: np.ndarray) -> np.ndarray:
    return np.r_[np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]), len(unit)]


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sketches may be of similar sets: of bins that either fills, 3/8 of the threshold's share agree, far below what similar sets have."""
    same, some = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1], dtype=np.int16), 0
    for k in range(x.shape[-1]):
        u, v = x[..., k], y[..., k]
        same += (u == v) & (u > 0)
        some = some + ((u | v) > 0)
    return same * 8 >= some * (3 * threshold)


def _promising(units: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The members of units that look similar to another one there by their sketches: 16 bits of the least hash of each bin, 0 for none, four in a long.

    Members with fewer than 12 filled bins go on unasked.
    """
    parts = [c for c in sketches.columns if c != "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, _UNIT):
            unit = run_ids([t.column(k).to_numpy() for k in _UNIT])
            edges = _edges(unit)
            asks, rows = (t.column(c).to_numpy() for c in ("asks", "rows"))
            sketch = np.column_stack([t.column(c).to_numpy() for c in parts]).view("<u2")
            keep = np.zeros(t.num_rows, dtype=bool)
            sizes = np.diff(edges)
            small = np.repeat(sizes <= SMALL, sizes)
            for d in range(1, min(SMALL, len(unit))):  # small units, all at once
                a = np.flatnonzero(small[d:] & (unit[d:] == unit[:-d]))
                a = a[(asks[a] & rows[a + d]) | (asks[a + d] & rows[a])]
                if not len(a):
                    break
                a = a[_alike(sketch[a], sketch[a + d], threshold)]
                keep[a] = keep[a + d] = True
            for k in np.flatnonzero(sizes > SMALL):
                a, b = edges[k], edges[k + 1]
                p, q = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(rows[a:b])
                if len(p) and len(q):
                    good = _alike(sketch[p][:, None], sketch[q][None, :], threshold) & (p[:, None] != q[None, :])
                    keep[p[good.any(axis=1)]] = True
                    keep[q[good.any(axis=0)]] = True
            keep |= (np.count_nonzero(sketch, axis=1) < 12) & np.repeat(sizes > 1, sizes)
            if keep.any():
                yield t.select([*_UNIT, "node", "asks", "rows"]).filter(pa.array(keep)).combine_chunks().to_batches()[0]

    placed = dealt(units.join(sketches, "node").select(*_UNIT, "node", "asks", "rows", *parts), *_UNIT).sortWithinPartitions(*_UNIT)
    return arrow_map(placed, run, "key long, i int, j int, node long, asks boolean, rows boolean")


def _compared(units: DataFrame, texts: DataFrame, shingles: Shingles, threshold: float) -> DataFrame:
    """(u, v): a spanning forest of the similar pairs in each unit (key, i, j), of members that ask and others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, _UNIT):
            unit = run_ids([t.column(k).to_numpy() for k in _UNIT])
            node, asks, rows = (t.column(c).to_numpy() for c in ("node", "asks", "rows"))
            edges, text = _edges(unit), t.column("text")
            us, vs, few, held = [], [], [], 0

            def put(at: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
                label = local_components(i, j, len(at))
                out = np.flatnonzero(label != np.arange(len(at)))
                us.append(node[at[out]])
                vs.append(node[at[label[out]]])

            def together() -> None:
                at = np.concatenate([np.arange(a, b) for a, b in few])
                h, of = shingles(text.take(at).to_pylist())
                i, j = small_pairs(h, of, unit[at], threshold)
                p, q = at[i], at[j]
                ok = (asks[p] & rows[q]) | (asks[q] & rows[p])
                put(at, i[ok], j[ok])

            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                p, q = np.flatnonzero(asks[a:b]), np.flatnonzero(rows[a:b])
                if b - a < 2 or not len(p) or not len(q):
                    continue
                if b - a <= SMALL:
                    few.append((a, b))
                    held += b - a
                    if held >= 200:
                        together()
                        few, held = [], 0
                    continue
                put(np.arange(a, b), *similar_pairs(*shingles(text.slice(a, b - a).to_pylist()), p, q, threshold))
            if few:
                together()
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    placed = dealt(units.join(texts, "node").select(*_UNIT, "node", "asks", "rows", "text"), *_UNIT).sortWithinPartitions(*_UNIT)
    return arrow_map(placed, run, "u long, v long")


def similar_groups(members: DataFrame, sketches: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingles: Shingles, threshold: float, name: str) -> DataFrame:
    """(node, component) of the nodes that chains of similar pairs join to a smaller node.

    members(key, node) has the buckets; each pair that shares one is a candidate, and the groups are those
    that comparing all candidates would give. sketches(node, ...) rules out what is far from similar before
    texts are fetched; texts_of(nodes) returns (node, text) for nodes(node). Buckets
    with the same members are compared once. A bucket over PART members is first cut into blocks by a hash,
    each with the bucket's pivots, which join what its blocks have in common. Members that are then not in
    the bucket's largest group meet all its members, block by block: quadratic only in those.
    """
    seen = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), seen(1).alias("a"), seen(2).alias("b")).where("n > 1")
    buckets = written(buckets.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key", "n"), f"{name}-buckets")
    live = written(members.join(buckets.hint("shuffle_hash"), "key").select("key", "node", "n"), f"{name}-members")
    # Few nodes share a bucket. Their sketches are picked once, so that the joins below do not each shuffle all sketches.
    sketches = written(sketches.join(live.select("node").distinct().hint("shuffle_hash"), "node", "left_semi"), f"{name}-sketches")
    of = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    parts = lambda n: F.ceil(F.col(n) / PART).cast("int")
    yes, no = F.lit(True), F.lit(False)

    def linked(units: DataFrame) -> DataFrame | None:
        left = written(_promising(units, sketches, threshold), f"{name}-units", 10_000)
        if not left.limit(1).count():
            return None
        texts = written(texts_of(left.select("node").distinct()), f"{name}-texts")
        links = written(_compared(left, texts, shingles, threshold), f"{name}-near")
        discard(left, texts)
        return links

    pivot = (F.col("n") > PART) & (of(F.col("n"), 11) < PIVOTS)
    own = F.explode(F.when(pivot, every(parts("n"))).otherwise(F.array(of(parts("n"), 7)))).alias("i")
    links = linked(live.select("key", "node", own).select("key", "i", F.lit(0).alias("j"), "node", yes.alias("asks"), yes.alias("rows")))
    if links is None:
        links = members.sparkSession.createDataFrame([], "u long, v long")
    found = components(links, f"{name}-links")
    large = live.where(F.col("n") > PART)
    if not large.limit(1).count():
        return found
    labelled = written(large.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("label")), f"{name}-large")
    groups = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    open_ = groups.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), (F.first("n") - F.max("k")).alias("s")).where("s > 0")
    rest = written(labelled.join(open_, "key"), f"{name}-open")
    if not rest.limit(1).count():
        return found
    ask = rest.where("label <> main").select("key", "node", of(parts("s"), 13).alias("i"), F.explode(every(parts("n"))).alias("j")).select("key", "i", "j", "node", yes.alias("asks"), no.alias("rows"))
    row = rest.select("key", "node", of(parts("n"), 17).alias("j"), F.explode(every(parts("s"))).alias("i")).select("key", "i", "j", "node", no.alias("asks"), yes.alias("rows"))
    more = linked(ask.unionByName(row))
    discard(labelled, rest, live, buckets)
    return found if more is None else components(links.unionByName(more), f"{name}-links")
