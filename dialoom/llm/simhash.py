"""SimHash near-duplicates, found by BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.bk_tree import Forest
from dialoom.llm.common import arrow_map, components, dealt, discard, local_components, run_ids, runs, utf8_of, written

#: Members of a part of a shard. A larger shard is dealt out in parts, and each pair of parts is a task of its own.
PART = 512


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """64 bits; bit i is 1 if it is set in over half of the shingles' XXH64 hashes. No words: 0."""
    found = text.lower().split()  # of bytes: A-Z only, and space and \\x09-\\x0D only
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    n, bits = len(shingles), np.zeros(64, dtype=np.int64)
    of = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):  # long texts in blocks
        h = np.array([of(s, seed) for s in shingles[at : at + (1 << 16)]], dtype="<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def majority(h: np.ndarray, of: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Fingerprints, as signed longs, of texts from their shingles' hashes and the number of the text of each, in order."""
    n = int(of[-1]) + 1
    bits = np.zeros((n, 64), dtype=np.int64)
    for at in range(0, len(h), block):
        own = of[at : at + block]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        bits[own[first]] += np.add.reduceat(np.unpackbits(h[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), first, axis=0, dtype=np.int64)
    return np.packbits(2 * bits > np.bincount(of, minlength=n)[:, None], axis=1, bitorder="little").view("<i8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. One pass, no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in utf8_of(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _tables(bits: int, radius: int) -> list[int]:
    """Masks, one per table: of radius+2 blocks two agree whenever at most `radius` bits differ, so a pair meets in a table."""
    edges = np.linspace(0, bits, radius + 3).round().astype(int)
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [a | b for a, b in combinations(blocks, 2)]


def near_links(nodes: DataFrame, radius: int = 4, part: int = PART) -> DataFrame:
    """(u, v): links that join all of nodes(node, fp) whose fingerprints differ in `radius` bits at most.

    fp is unique in nodes. A shard holds the fingerprints that agree in two of six blocks; any pair
    within four bits shares a shard. Its BK-tree is built where its queries are. Shards over `part`
    members are cut into parts by a hash, and every two parts meet in a task of their own, so no task
    holds more than 2 x part of one shard. Of the pairs found in a task only a spanning forest leaves it.
    """
    masks = F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)) for m in _tables(64, radius)])
    rows = nodes.select("node", "fp", F.posexplode(masks).alias("table", "mask")).select("node", "fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = written(rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-shards")
    live = rows.join(sizes, ["table", "key"])
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), parts).cast("int")
    units = live.select("table", "key", "node", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).select(
        "table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "fp"
    )
    keys = ["table", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            got = {c: t.column(c).to_numpy() for c in (*keys, "own", "node", "fp")}
            unit, fp, node = run_ids([got[k] for k in keys]), got["fp"].view(np.uint64), got["node"]
            tree, asks = got["own"] == got["i"], got["own"] == got["j"]
            members, askers = np.flatnonzero(tree), np.flatnonzero(asks)
            if not len(members) or not len(askers):
                continue
            forest = Forest(fp[members], unit[members])
            label = np.arange(len(fp))
            for q, m in forest.search(fp[askers], unit[askers], radius):
                a, b = askers[q], members[m]
                differ = a != b
                a, b = label[a[differ]], label[b[differ]]
                label = local_components(a, b, len(fp))[label]
            order = np.lexsort((node, label))
            first = np.ones(len(order), dtype=bool)
            first[1:] = label[order][1:] != label[order][:-1]
            low = node[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
            out = node[order] != low
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[order][out]), pa.array(low[out])], names=["u", "v"])

    return arrow_map(dealt(units, *keys).sortWithinPartitions(*keys), run, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id that links reach. Texts that are null, empty or without words
    have fingerprint zero and are linked like any other. Equal fingerprints are one node, whatever the
    number of their rows. Repeated rows are each returned. A fingerprint of which all rows have a null
    doc_id takes no part in links; its component_id is null. Other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    found = components(near_links(nodes.where("node is not null"), radius), "simhash-links")
    groups = written(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "simhash-groups")
    discard(nodes)
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
