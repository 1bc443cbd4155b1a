"""Near-duplicate documents by SimHash and MinHash of word shingles, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, components, discard, texts_of, written
from dialoom.llm.similar import similar_groups
from dialoom.llm.simhash import majority, near_links

#: Words in a shingle; bands, and rows of a band: a pair at a similarity of 0.8 shares a band with a probability of 0.9998.
WORDS, BANDS, ROWS = 5, 16, 4
#: Characters, about, that are hashed at once.
BLOCK = 1 << 21
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of WORDS words, and the number of the text of each; a shorter text is one shingle. Words as in op3."""
    found = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    found = [w if len(w) >= WORDS else [b" ".join(w), *[b""] * (WORDS - 1)] for w in found]
    sizes = np.array([len(w) for w in found])
    h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(found)), dtype=np.uint64, count=int(sizes.sum()))
    of = np.repeat(np.arange(len(found)), sizes)
    n = len(h) - WORDS + 1
    out = h[:n]
    for k in range(1, WORDS):
        out = _mixed(out) * _FACTOR + h[k : n + k]
    fits = of[:n] == of[WORDS - 1 :]
    return _mixed(out[fits]), of[:n][fits]


def band_keys(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BANDS) keys by MinHash of shingles' hashes, and the sketch: 16 bits of each least hash, four in a long."""
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    rng = np.random.default_rng(5)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(starts), axis=0)
    sketch = np.zeros((len(starts), BANDS * ROWS), dtype="<u2")
    for r in range(ROWS):
        for b in range(BANDS):
            least = np.minimum.reduceat(_mixed(h ^ rng.integers(1 << 64, dtype=np.uint64)), starts)
            keys[:, b] = _mixed(keys[:, b] * _FACTOR ^ least)
            sketch[:, r * BANDS + b] = np.maximum(least & np.uint64(0xFFFF), 1)
    return keys.view(np.int64), sketch.view("<i8")


_KEYS, _SKETCH = [f"b{k}" for k in range(BANDS)], [f"s{k}" for k in range(BANDS * ROWS // 4)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, fp, s0..., b0...) of docs(doc_id, th, text): node hashes the set of shingles; then its SimHash fingerprint, sketch and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(2))
            ends = np.cumsum([len(t) for t in texts])
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK)), len(texts)]) if len(texts) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                h, of = shingles(texts[low:high])
                keys, sketch = band_keys(h, of)
                edges = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)].tolist()
                node = np.array([xxhash.xxh64_intdigest(np.unique(h[x:y]).tobytes()) for x, y in zip(edges[:-1], edges[1:], strict=True)], dtype=np.uint64).view(np.int64)
                part = b.slice(low, high - low)
                numbers = np.hstack([node[:, None], majority(h, of)[:, None], sketch, keys]).T.copy()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, numbers)], names=["doc_id", "th", "node", "fp", *_SKETCH, *_KEYS])

    return arrow_map(docs, run, f"doc_id long, th long, node long, fp long, {', '.join(f'{k} long' for k in _SKETCH + _KEYS)}")


def _fingerprint_groups(nodes: DataFrame) -> DataFrame:
    """(key, node): nodes whose fingerprints chains of at most four differing bits join, by operator 3's BK-trees."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "near-prints")
    found = components(near_links(prints), "near-print-links").withColumnRenamed("node", "low")
    joined = prints.join(found, prints.node == found.low, "left").select("fp", F.coalesce("component", "node").alias("key"))
    return nodes.select("fp", "node").join(joined, "fp").select(F.xxhash64("key", F.lit(64)).alias("key"), "node")


def near_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, th, n, kept) for each different (doc_id, th) of docs(doc_id, text), of which docs has n rows; th is xxhash64 of the text, null as empty.

    Documents belong to a group if chains of similar ones (Jaccard of five-word shingles, threshold or more) join
    them; of a group the pair with the smallest doc_id, then th, is kept; a null doc_id comes after all others. Candidates share a
    group of SimHash fingerprints (operator 3) or a band of MinHash, and each pair of them is compared exactly.
    Texts without words are equal. Texts are compared whole; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    prints = written(signatures(texts), "near-signatures")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    longs = ["fp", *_SKETCH, *_KEYS]
    nodes = written(prints.groupBy("node").agg(F.min("th").alias("th"), *[F.min(c).alias(c) for c in longs]), "near-nodes")
    members = nodes.select(F.explode(F.array(*_KEYS)).alias("key"), "node").unionByName(_fingerprint_groups(nodes))

    def of(needed: DataFrame) -> DataFrame:
        one = nodes.select("node", "th").join(needed, "node")
        return texts.select("th", "text").join(one.hint("shuffle_hash"), "th").groupBy("node").agg(F.min("text").alias("text"))

    found = similar_groups(members, nodes.select("node", *_SKETCH), of, shingles, threshold, "near").withColumnRenamed("node", "member")
    pairs = prints.groupBy("doc_id", "th").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    grouped = written(pairs.join(found, pairs.node == found.member, "left").select("doc_id", "th", "n", F.coalesce("component", "node").alias("component")), "near-groups")
    keep = written(grouped.groupBy("component").agg(F.min(place).alias("keep")), "near-keep")
    discard(prints, nodes)
    return grouped.join(keep, "component").select("doc_id", "th", "n", (place == F.col("keep")).alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each group of near_documents. Of rows that repeat the kept doc_id and text, that with the least other columns stays."""
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    id_, th = F.col("row.doc_id").cast("long"), F.xxhash64(F.coalesce("row.text", F.lit("")))
    odd = written(near_documents(docs.select("doc_id", "text"), threshold).where("n > 1 or not kept"), "near-odd")
    same = id_.eqNullSafe(F.col("doc_id")) & (th == F.col("th"))
    once = rows.join(odd, same, "left_anti")
    again = rows.join(odd.where("kept"), same).groupBy("doc_id", "th").agg(F.min("row").alias("row")).select("row")
    return once.unionByName(again).select("row.*")
