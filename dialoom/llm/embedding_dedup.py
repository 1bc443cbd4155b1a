"""Near-duplicate vectors by NN-descent on a neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, components, dealt, discard, local_components, run_ids, runs, written


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    neighbours: int = 16  # length of a list
    largest: int = 64  # length up to which a saturated list grows; beyond, the vector is searched exactly
    tables: int = 6  # random partitions that start the graph
    block: int = 256  # rows that are compared with each other at the start
    rounds: int = 2  # of neighbours-of-neighbours joins, at least
    most_rounds: int = 6  # if the audit asks for more
    audit: int = 512  # vectors, about, whose links are counted exactly
    recall: float = 0.99
    chunk: int = 8192  # queries or rows of a block in an exact search
    seed: int = 13
    kind: str = "<f4"  # components as they are stored; cosines are of doubles


def _vectors(column: pa.Array, n: int, s: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=s.kind).reshape(n, -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(vec_id, k, vec), the length and bytes of usable vectors, and the kind of their components; vec is null for those that link with nothing.

    Those are null, empty or zero vectors, and vectors with null or non-finite components. Floats stay floats, which
    hold them exactly; any other number becomes a double.
    """
    name, kind = ("float", "<f4") if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else ("double", "<f8")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{name}>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("v", F.when(~bad & F.exists("v", lambda x: x != 0) & (F.size("v") > 0), F.col("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [None if v is None else np.asarray(v, dtype=kind).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else len(v) // int(kind[2]) for v in packed], pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "k", "vec"])

    return arrow_map(rows, run, "vec_id long, k int, vec binary"), kind


LIST = "src long, dst long, sim double"


def _start(nodes: DataFrame, n: int, s: Settings) -> DataFrame:
    """Neighbours within blocks of rows that are next to each other under random hyperplanes, once per table."""
    bits = max(1, round(math.log2(max(2, n / s.block))))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            x = _unit(_vectors(b.column(1), b.num_rows, s))
            if planes is None:
                planes = np.random.default_rng(s.seed).normal(size=(x.shape[1], s.tables, bits + 1))
            for t in range(s.tables):
                p = x @ planes[:, t]
                cell = ((p[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(cell ^ (cell >> 1)), pa.array(p[:, bits]), b.column(0), b.column(1)], names=["t", "cell", "p", "node", "vec"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held, last = s.block // 2, None, None  # blocks overlap by half; of what was read, less than a block waits
        for batch in batches:
            of = batch.column("t").to_numpy()
            for low, high in pairwise([*np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist(), len(of)] if len(of) else []):
                part = batch.slice(low, high - low)
                t, ids, x = of[low], part.column("node").to_numpy(), _unit(_vectors(part.column("vec"), part.num_rows, s))
                if held is not None and t != last:
                    yield from _best(*held, s.neighbours)
                    held = None
                if held is not None:
                    ids, x = np.concatenate([held[0], ids]), np.vstack([held[1], x])
                a = 0
                while a + s.block < len(ids):
                    yield from _best(ids[a : a + s.block], x[a : a + s.block], s.neighbours)
                    a += step
                held, last = (ids[a:], x[a:]), t
        if held is not None:
            yield from _best(*held, s.neighbours)

    keyed = arrow_map(nodes.select("node", "vec"), keys, "t long, cell long, p double, node long, vec binary")
    order = ["t", "cell", "p", "node"]
    return arrow_map(keyed.repartitionByRange(*order).sortWithinPartitions(*order), blocks, LIST)


def _best(ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Of a few rows, the k most similar others of each."""
    if len(ids) < 2:
        return
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(sim, at, 1).ravel())], names=["src", "dst", "sim"])


def _merge(lists: DataFrame, s: Settings) -> DataFrame:
    """The best of each list without repeats: `neighbours` of them, or twice, four times... as many where all of these are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["src"]):
            src, dst, sim = (t.column(c).to_numpy() for c in ("src", "dst", "sim"))
            order = np.lexsort((-sim, dst, src))
            src, dst, sim = src[order], dst[order], sim[order]
            new = np.ones(len(src), dtype=bool)
            new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
            src, dst, sim = src[new], dst[new], sim[new]
            order = np.lexsort((dst, -sim, src))
            src, dst, sim = src[order], dst[order], sim[order]
            first = np.r_[True, src[1:] != src[:-1]]
            start = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            rank = np.arange(len(src)) - start[group]
            links = np.bincount(group, sim >= s.threshold)
            size = np.full(len(start), s.neighbours)
            while (more := (links >= size) & (size < s.largest)).any():
                size[more] *= 2
            keep = rank < size[group]
            yield pa.RecordBatch.from_arrays([pa.array(src[keep]), pa.array(dst[keep]), pa.array(sim[keep])], names=["src", "dst", "sim"])

    return arrow_map(lists.repartition("src").sortWithinPartitions("src"), run, LIST)


def _refine(lists: DataFrame, nodes: DataFrame, s: Settings, turn: int) -> DataFrame:
    """Candidates from joining the neighbours of each vector, in either direction, with each other.

    A hub with many neighbours joins 2 x `neighbours` of them in a round, others in the next; what all rounds
    leave out the audit finds, and the exact search makes up for.
    """
    around = lists.select(F.col("src").alias("hub"), F.col("dst").alias("node"), "sim").unionByName(lists.select(F.col("dst").alias("hub"), F.col("src").alias("node"), "sim"))
    floor = lists.groupBy("src").agg(F.min("sim").alias("floor")).withColumnRenamed("src", "node")
    rich = written(nodes.join(floor, "node").select("node", "vec", "floor"), "nn-vectors")
    most = 2 * s.neighbours

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["hub"]):
            hub, ids, floors = (t.column(c).to_numpy() for c in ("hub", "node", "floor"))
            x = _unit(_vectors(t.column("vec"), t.num_rows, s))
            starts = np.r_[0, np.flatnonzero(hub[1:] != hub[:-1]) + 1, len(hub)]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                own, at = np.unique(ids[a:b], return_index=True)
                at = np.sort(at)[:most] + a  # links first, in an order of their own, so that not the same few meet again; then the most similar
                if len(at) < 2:
                    continue
                sim = x[at] @ x[at].T
                np.fill_diagonal(sim, -2)
                better = sim > floors[at][:, None]
                if better.any():
                    k = min(6, len(at) - 1)
                    best = np.zeros_like(better)
                    np.put_along_axis(best, np.argpartition(-sim, k - 1, axis=1)[:, :k], True, 1)
                    i, j = np.nonzero((better & best) | (sim >= s.threshold))  # the best few, and every link
                    out.append((ids[at][i], ids[at][j], sim[i, j]))
            if out:
                src, dst, sim = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(sim)], names=["src", "dst", "sim"])

    near = dealt(around.join(rich, "node").select("hub", "node", "sim", "vec", "floor"), "hub").sortWithinPartitions("hub", F.when(F.col("sim") >= s.threshold, F.pmod(F.xxhash64("hub", "node", F.lit(turn)), F.lit(1000)) - 2000).otherwise(-F.col("sim")))
    return arrow_map(near, run, LIST)


def exact_links(queries: DataFrame, nodes: DataFrame, n_queries: int, n: int, s: Settings) -> DataFrame:
    """(src, dst, n): for each query, how many rows its links stand for (n, summed over dst's block), and links that join it to all of them.

    A stated set of queries against all vectors, both cut into chunks by a hash; a block of the two is a
    task's unit. Of the links found in a block, only counts and a spanning forest leave it.
    """
    q, d = max(1, -(-n_queries // s.chunk)), max(1, -(-n // s.chunk))
    part = lambda k, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asks = queries.select("node", "vec", "m", F.lit(0).alias("side"), part(q, 1).alias("q"), every(d).alias("d"))
    rows = nodes.select("node", "vec", "m", F.lit(1).alias("side"), part(d, 2).alias("d"), every(q).alias("q")).select("node", "vec", "m", "side", "q", "d")
    keys = ["q", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            unit = run_ids([t.column(k).to_numpy() for k in keys])
            side, ids, m = (t.column(c).to_numpy() for c in ("side", "node", "m"))
            x = _unit(_vectors(t.column("vec"), t.num_rows, s))
            for u in range(unit[-1] + 1):
                here = np.flatnonzero(unit == u)
                a, b = here[side[here] == 0], here[side[here] == 1]
                if not len(a) or not len(b):
                    continue
                counts, label = np.zeros(len(a), dtype=np.int64), np.arange(len(a) + len(b))
                for i in range(0, len(a), 512):
                    near = (x[a[i : i + 512]] @ x[b].T) >= s.threshold
                    near &= ids[a[i : i + 512], None] != ids[b][None, :]
                    counts[i : i + 512] = near @ m[b]
                    f, g = np.nonzero(near)
                    label = local_components(label[f + i], label[g + len(a)], len(label))[label]
                both = np.concatenate([ids[a], ids[b]])
                low = np.full(len(label), np.iinfo(np.int64).max)
                np.minimum.at(low, label, both)
                root = low[label]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(root[: len(a)]), pa.array(counts)], names=["src", "dst", "n"])
                other = both[len(a) :] != root[len(a) :]
                yield pa.RecordBatch.from_arrays([pa.array(both[len(a) :][other]), pa.array(root[len(a) :][other]), pa.array(np.full(int(other.sum()), -1))], names=["src", "dst", "n"])

    return arrow_map(dealt(asks.unionByName(rows), *keys).sortWithinPartitions(*keys, "side"), run, "src long, dst long, n long")


def _audited(lists: DataFrame, nodes: DataFrame, n: int, s: Settings) -> DataFrame:
    """Of all nodes and of those with links so far, about `audit` each, by a hash."""
    chance = lambda k: F.pmod(F.xxhash64("node", F.lit(s.seed)), F.lit(max(1, k // s.audit))) == 0
    linked = written(lists.where(F.col("sim") >= s.threshold).select(F.col("src").alias("node")).distinct(), "nn-linked")
    some = linked.where(chance(linked.count())).unionByName(nodes.where(chance(n)).select("node")).distinct()
    return nodes.join(some, "node")


def _search(nodes: DataFrame, s: Settings) -> tuple[DataFrame, dict]:
    """(node, n, component) of nodes(node, vec, m) of one length: n rows of other nodes are linked with it."""
    n = nodes.count()
    report = {"nodes": n, "rounds": 0, "recall": 1.0, "searched": 0}
    if n < 2:
        return nodes.select("node", F.lit(0).cast("long").alias("n"), F.col("node").alias("component")), report
    lists, truth = written(_merge(_start(nodes, n, s), s), "nn-lists"), None
    while report["rounds"] < s.most_rounds:
        last, lists = lists, written(_merge(lists.unionByName(_refine(lists, nodes, s, report["rounds"])), s), "nn-lists")
        discard(last)
        report["rounds"] += 1
        if report["rounds"] < s.rounds:
            continue
        links, full = _links(lists, nodes, s)
        if truth is None:
            truth = written(exact_links(_audited(lists, nodes, n, s), nodes, min(n, 4 * s.audit), n, s).where("n >= 0").groupBy("src").agg(F.sum("n").alias("truth")), "nn-truth")
        got = truth.join(links.groupBy("src").agg(F.sum("m").alias("found")), "src", "left").join(full.withColumnRenamed("node", "src"), "src", "left_anti")
        sums = got.agg(F.sum("truth").alias("t"), F.sum(F.least("truth", F.coalesce("found", F.lit(0)))).alias("f")).first()
        report["recall"] = (sums.f / sums.t) if sums.t else 1.0
        if report["recall"] >= s.recall:
            break
    links, full = _links(lists, nodes, s)
    if report["recall"] < s.recall:  # the graph does not get there: every node is searched exactly
        full, report["recall"] = nodes.select("node"), 1.0
    full = written(full, "nn-full")
    report["searched"] = full.count()
    joins = links.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    counts = nodes.join(links.groupBy("src").agg(F.sum("m").alias("n")), nodes.node == F.col("src"), "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))
    if report["searched"]:
        found = written(exact_links(nodes.join(full, "node"), nodes, report["searched"], n, s), "nn-searched")
        joins = joins.unionByName(found.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        whole = found.where("n >= 0").groupBy("src").agg(F.sum("n").alias("all"))
        counts = counts.join(whole, counts.node == whole.src, "left").select("node", F.coalesce("all", "n").alias("n"))
    joined = components(joins, "nn-links").withColumnRenamed("node", "u")
    return written(counts.join(joined, counts.node == joined.u, "left").select("node", "n", F.coalesce("component", "node").alias("component")), "nn-counts"), report


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", s: Settings = Settings()) -> tuple[DataFrame, dict]:
    """(vec_id, n_links, component_id, kept) for each row of vectors, and a report with the audited recall.

    Equal vectors are one node that stands for its rows; vectors of different lengths have no cosine, and each length is searched
    by itself. The graph starts from random partitions; each round joins
    neighbours of neighbours. A list whose entries are all links is saturated and grows; one that is
    saturated at its largest is searched exactly, in blocks. The audit counts the links of a hash-chosen
    set exactly, and asks for more rounds while too few were found; if the last round leaves too few, every vector is
    searched exactly. Of equally similar entries a list keeps those that come first among the different vectors. Vectors that are no vectors (see
    clean) have no links and are their own component. Rows that repeat a vec_id are each returned; as equal
    vectors they link with each other. A null vec_id has no links and a null component. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    cleaned, kind = clean(vectors, id_col, vec_col)
    rows, s = written(cleaned, "nn-rows"), replace(s, kind=kind)
    real = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    different = rows.where(real).groupBy("vec").agg(F.min("vec_id").alias("low"), F.min("k").alias("k"), F.count(F.lit(1)).alias("m"))
    nodes = written(different.withColumn("node", F.monotonically_increasing_id()), "nn-nodes")  # numbered as written, as a vec_id may be on different vectors
    report, counts = {"nodes": 0, "rounds": 0, "recall": 1.0, "searched": 0}, None
    for r in sorted(nodes.select("k").distinct().collect()):  # the different lengths: one, as a rule
        found, own = _search(nodes.where(F.col("k") == r.k).select("node", "vec", "m"), s)
        report = {key: min(report[key], own[key]) if key == "recall" else report[key] + own[key] for key in report}
        counts = found if counts is None else counts.unionByName(found)
    alone = rows.where(~real).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if counts is not None:
        known = nodes.select("node", "vec", "low", "m").join(counts, "node")
        lows = written(known.groupBy("component").agg(F.min("low").alias("component_id")), "nn-lows")
        of = written(known.join(lows, "component").select("vec", (F.col("n") + F.col("m") - 1).alias("n_links"), "component_id"), "nn-found")
        alone = rows.where(real).join(of, "vec").select("vec_id", "n_links", "component_id").unionByName(alone)
    return alone.withColumn("kept", F.col("vec_id") == F.col("component_id")), report


def _links(lists: DataFrame, nodes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(src, dst, m): links in both directions, dst standing for m rows; and the nodes whose lists are saturated at their largest."""
    near = lists.where(F.col("sim") >= s.threshold).select("src", "dst")
    full = near.groupBy("src").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= s.largest).select(F.col("src").alias("node"))
    both = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return both.join(nodes.select(F.col("node").alias("dst"), "m"), "dst").select("src", "dst", "m"), full


def embedding_query(vectors: DataFrame) -> DataFrame:
    found, report = near_vectors(vectors)
    return found.withColumn("audited_recall", F.lit(float(report["recall"])))
