"""The best vectors for each of many queries: matrix products rule out pairs, the others are scored as the column expressions score them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors and queries of a matrix product, and pairs that are scored exactly at once.
ROWS, ASKED, PAIRS = 2048, 512, 1 << 16
#: Parts of the vectors and of the queries, at most. A task holds one part of each: queries whole, vectors block by block.
PARTS, QUERY_PARTS = 32, 4
_U = float(np.finfo(np.float64).eps)
#: Classes of a score, in the order of ranks: not a number (the greatest, as in SQL), a number, null.
_NAN, _NUMBER, _NULL = 0, 1, 2


class _Block:
    """Vectors as doubles, with what products and scores need of them."""

    def __init__(self, m: np.ndarray, known: np.ndarray):
        self.m, self.known, self.columns = m, known, np.ascontiguousarray(m.T)
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.sqrt(_summed(self.columns, self.columns))
        self.odd = ~(known & (np.abs(m).max(axis=1, initial=0.0) < 1e100))  # no product says anything of these
        self.plain = np.where(self.odd[:, None], 0.0, m)
        self.length = np.where(self.odd, 0.0, self.norm)
        self.unit = self.plain / np.maximum(self.length, 1e-10)[:, None]

    def part(self, a: int, b: int) -> _Block:
        out = object.__new__(_Block)
        out.m, out.known, out.columns, out.norm, out.odd, out.plain, out.length, out.unit = self.m[a:b], self.known[a:b], self.columns[:, a:b], self.norm[a:b], self.odd[a:b], self.plain[a:b], self.length[a:b], self.unit[a:b]
        return out


def _block(column: pa.Array, dimensions: int) -> _Block:
    """known is false for a vector that is null, has a null component or another length: all its scores are null."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.slice(column.offsets[0].as_py(), int(lengths.sum()))
    gaps = np.zeros(len(values), dtype=bool) if not values.null_count else values.is_null().to_numpy(zero_copy_only=False)
    whole = values.to_numpy(zero_copy_only=False).astype(np.float64)
    fits = (lengths == dimensions) & (column.is_valid().to_numpy(zero_copy_only=False))
    m, known = np.zeros((len(column), dimensions)), fits.copy()
    take = np.repeat(fits, lengths)
    m[fits] = whole[take].reshape(-1, dimensions)
    known[fits] = ~gaps[take].reshape(-1, dimensions).any(axis=1)
    m[~known] = 0.0
    return _Block(m, known)


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products over the first axis, one after the other as SQL's aggregate adds them."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def _exact(metric: str, q: _Block, i: np.ndarray, r: _Block, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    if metric == "l2":
        for x, y in zip(q.columns, r.columns, strict=True):
            d = x[i] - y[j]
            out += d * d
        return 1 / (1 + np.sqrt(out))
    for x, y in zip(q.columns, r.columns, strict=True):
        out += x[i] * y[j]
    return out if metric == "dot_product" else out / (np.maximum(r.norm, 1e-10)[j] * np.maximum(q.norm, 1e-10)[i])


def _products(metric: str, q: _Block, r: _Block) -> tuple[np.ndarray, np.ndarray]:
    """A value for each pair that orders as its score does, and how far that of a query can be off by rounding, with room to spare."""
    off = 8 * (q.m.shape[1] + 8) * _U
    if metric == "cosine":
        return q.unit @ r.unit.T, np.full(len(q.m), off)
    dots, most = q.plain @ r.plain.T, r.length.max(initial=0.0)
    if metric == "dot_product":
        return dots, off * q.length * most + 1e-300
    return 2 * dots - q.length[:, None] ** 2 - r.length[None, :] ** 2, off * (q.length + most) ** 2 + 1e-300


def _floor(metric: str, least: np.ndarray) -> np.ndarray:
    """The least value of a pair whose score is not below `least`, but for what products are off."""
    if metric != "l2":
        return least
    with np.errstate(divide="ignore"):
        far = (1 + 32 * _U) / least - 1
        return -far * far * (1 + 32 * _U)


class _Best:
    """The top_k (class, score, place) of each query so far; of equal ones the first place counts."""

    def __init__(self, queries: int, top_k: int):
        self.kind = np.full((queries, top_k), 9, dtype=np.int8)  # 9: none yet
        self.raw, self.at = np.zeros((queries, top_k)), np.full((queries, top_k), -1)

    def put(self, i: np.ndarray, kind: np.ndarray, raw: np.ndarray, at: np.ndarray) -> None:
        k, touched = self.kind.shape[1], np.unique(i)
        who = np.r_[np.repeat(touched, k), i]
        kind, raw, at = np.r_[self.kind[touched].ravel(), kind], np.r_[self.raw[touched].ravel(), raw], np.r_[self.at[touched].ravel(), at]
        order = np.lexsort((at, -raw, kind, who))
        first = np.flatnonzero(np.r_[True, who[order][1:] != who[order][:-1]])
        order = order[first[:, None] + np.arange(k)]  # every query has k or more
        self.kind[touched], self.raw[touched], self.at[touched] = kind[order], raw[order], at[order]

    def least(self, a: int, b: int) -> np.ndarray:
        """What a score has to reach to count for the queries a to b."""
        kind = self.kind[a:b, -1]
        return np.where(kind == _NUMBER, self.raw[a:b, -1], np.where(kind == _NAN, np.inf, -np.inf))


def _meet(metric: str, q: _Block, first: int, r: _Block, place: int, best: _Best) -> None:
    value, off = _products(metric, q, r)
    k = best.kind.shape[1]
    least = best.least(first, first + len(q.m))
    low = np.where(np.isfinite(least), _floor(metric, np.where(np.isfinite(least), least, 1.0)) - off, least)
    if len(r.m) > k and np.isneginf(low).any():  # at the start: the best of this block alone set a bound
        value[:, r.odd] = -np.inf
        own = np.partition(value, len(r.m) - k, axis=1)[:, len(r.m) - k]
        with np.errstate(invalid="ignore"):
            if metric == "l2":
                own = _floor(metric, 1 / (1 + np.sqrt(np.maximum(off - own, 0))))
            low = np.where(np.isneginf(low), own - 2 * off, low)
    value[:, r.odd] = np.inf
    value[q.odd] = np.inf
    i, j = np.nonzero(value >= low[:, None])
    for a in range(0, len(i), PAIRS):
        x, y = i[a : a + PAIRS], j[a : a + PAIRS]
        with np.errstate(over="ignore", invalid="ignore"):
            raw = _exact(metric, q, x, r, y)
        kind = np.where(q.known[x] & r.known[y], np.where(np.isnan(raw), _NAN, _NUMBER), _NULL).astype(np.int8)
        raw[kind != _NUMBER] = 0.0
        best.put(x + first, kind, raw, y + place)


def _run(metric: str, dimensions: int, top_k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids, place, q, best = [], [], 0, None, None
        for b in batches:  # all queries, then the vectors in the order of their ids
            cut = int(np.count_nonzero(b.column("kind").to_numpy() == 0))
            if cut:
                asked.append(b.slice(0, cut))
            if cut == b.num_rows:
                continue
            if not asked:
                return
            if q is None:
                q = _block(pa.concat_arrays([x.column("v") for x in asked]), dimensions)
                best = _Best(len(q.m), top_k)
            for at in range(cut, b.num_rows, ROWS):
                rows = b.slice(at, ROWS)
                r = _block(rows.column("v"), dimensions)
                for a in range(0, len(q.m), ASKED):
                    _meet(metric, q.part(a, a + ASKED), a, r, place, best)
                ids.append(rows.column("doc_id"))
                place += rows.num_rows
        if best is None:
            return
        ids, names = pa.chunked_array(ids), pa.chunked_array([x.column("query_id") for x in asked])
        for a in range(0, len(best.kind), 1000):
            i, k = np.nonzero(best.kind[a : a + 1000] != 9)
            i += a
            raw = pa.array(best.raw[i, k], mask=best.kind[i, k] == _NULL)
            raw = raw if not (best.kind[i, k] == _NAN).any() else pa.array(np.where(best.kind[i, k] == _NAN, np.nan, best.raw[i, k]), mask=best.kind[i, k] == _NULL, from_pandas=False)
            whole = [x.combine_chunks() for x in (names.take(pa.array(i)), ids.take(pa.array(best.at[i, k])))]
            yield pa.RecordBatch.from_arrays([*whole, raw], names=["query_id", "doc_id", "raw"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, metric: str, dimensions: int, top_k: int) -> DataFrame:
    """(query_id, doc_id, raw): of each part of vectors(doc_id, v) the top_k for each of queries(query_id, query_vector), by score and doc_id.

    Every query meets every vector. A part of the queries goes to each part of the vectors, so a task holds a share of
    both; how many parts there are depends on spark.sql.shuffle.partitions only.
    """
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n, PARTS))
    sides = max(1, min(n // parts, QUERY_PARTS))
    types = {vectors.schema["v"].dataType.simpleString(), queries.schema["query_vector"].dataType.simpleString()}
    to = "array<float>" if types == {"array<float>"} else "array<double>"
    of = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    ids = {c: t.schema[c].dataType for t, c in ((vectors, "doc_id"), (queries, "query_id"))}
    ask = queries.select(every(parts).alias("i"), of("query_id", sides).alias("j"), F.lit(0).alias("kind"), "query_id", F.lit(None).cast(ids["doc_id"]).alias("doc_id"), F.col("query_vector").cast(to).alias("v"))
    row = vectors.select(of("doc_id", parts).alias("i"), every(sides).alias("j"), F.lit(1).alias("kind"), F.lit(None).cast(ids["query_id"]).alias("query_id"), "doc_id", F.col("v").cast(to).alias("v"))
    both = ask.unionByName(row).repartitionById(parts * sides, (F.col("i") * sides + F.col("j")).cast("int"))
    both = both.sortWithinPartitions("kind", "doc_id").select("kind", "query_id", "doc_id", "v")
    kind = lambda c: ids[c].simpleString()
    return both.mapInArrow(_run(metric, dimensions, top_k), f"query_id {kind('query_id')}, doc_id {kind('doc_id')}, raw double")
