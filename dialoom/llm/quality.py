"""Document quality: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, collected, discard, each_utf8, written

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "letters", "upper", "digits", "spaces", "line_ends", "stops", "commas", "exclaims", "symbols", "brackets", "non_ascii", "entropy",
    "word_mean", "word_std", "word_max", "distinct_words", "top_word", "distinct_pairs", "caps_words", "odd_ends", "line_mean", "distinct_lines", "log_longest_line",
)
_CLASSES = {
    "letters": bytes(range(65, 91)) + bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digits": b"0123456789", "spaces": b" ", "line_ends": b"\n", "stops": b".", "commas": b",;:",
    "exclaims": b"!?", "symbols": b"#$%&*@^~|+=\\/_", "brackets": b"<>{}[]()", "non_ascii": bytes(range(128, 256)),
}
_MASKS = np.array([np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in _CLASSES.values()], dtype=np.float64)
_END = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?") | frozenset(range(128, 256))


def _distinct_pairs(words: list[bytes], counts: Counter) -> int:
    """How many different pairs of neighbours there are; in long texts as numbers, a block at a time, which take less room than tuples."""
    if len(words) < 4096:
        return len(set(zip(words, words[1:], strict=False)))
    number = {w: k for k, w in enumerate(counts)}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    return len(np.unique(ids[:-1] * len(number) + ids[1:]))


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a whole text. Of an empty one: all zero."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    there = share[share > 0]
    words, lines = text.split(), text.split(b"\n")
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = _distinct_pairs(words, counts) / max(1, len(words) - 1)
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), *(_MASKS @ share), float(-(there * np.log2(there)).sum()),
        float(sizes.mean()), float(sizes.std()), math.log1p(float(sizes.max())), len(counts) / k, max(counts.values(), default=0) / k, pairs,
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / k, sum(c for w, c in counts.items() if w[-1] not in _END) / k,
        math.log1p(n / len(lines)), len(set(lines)) / len(lines), math.log1p(max(map(len, lines))),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, x): x holds the STATISTICS. One pass, no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in each_utf8(b.column(1))], dtype=np.float32).reshape(b.num_rows, -1)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), flat], names=["doc_id", "text_hash", "x"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")), run, "doc_id long, text_hash long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


@dataclass
class Features:
    """z -> sqrt(2/D) cos(Wz + b) of the standardised statistics: its dot products approximate a Gaussian kernel."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    phases: np.ndarray

    @classmethod
    def make(cls, mean: np.ndarray, std: np.ndarray, size: int, width: float, seed: int) -> Features:
        rng = np.random.default_rng(seed)
        return cls(mean, np.where(std > 1e-9, std, 1.0), rng.normal(size=(len(mean), size)) / width, rng.uniform(0, 2 * np.pi, size))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.weights + self.phases), np.ones((len(x), 1))])


@dataclass
class Model:
    features: Features
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.beta, self.knots, self.values)


def isotonic(x: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to positive/total at the sorted points x (pool adjacent violators), as knots."""
    blocks: list[list[float]] = []
    for a, n, p in zip(x, total, positive, strict=True):
        blocks.append([a, a, n, p])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, n, p = blocks.pop()
            blocks[-1][1] = hi
            blocks[-1][2] += n
            blocks[-1][3] += p
    ends = [(b[0], b[3] / b[2]) for b in blocks], [(b[1], b[3] / b[2]) for b in blocks]
    points = sorted({*ends[0], *ends[1]})
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def fit(stats: DataFrame, labels: DataFrame, size: int = 256, width: float = 4.0, ridge: float = 1e-3, bins: int = 512, seed: int = 7) -> Model | None:
    """Fits on stats(doc_id, x) joined with labels(doc_id, y); None without labelled rows of both kinds.

    The scale of each statistic comes from all of stats. Each partition sums its own normal equations,
    and their rows are summed by number, so that the driver receives one (size+1)-square matrix. Of the
    labelled rows, those whose hash falls in one fifth calibrate: their scores are counted in `bins`
    equal bins, to which the isotonic function is fitted.
    """
    d = len(STATISTICS)
    moments = stats.select([F.col("x")[i].cast("double").alias(f"x{i}") for i in range(d)]).agg(*[f(f"x{i}") for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if moments[0] is None:
        return None
    m = np.array(moments, dtype=np.float64).reshape(d, 2)
    features = Features.make(m[:, 0], m[:, 1], size, width, seed)
    train = written(stats.join(labels.where("doc_id is not null and y is not null").select("doc_id", F.col("y").cast("double").alias("y"), (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0).alias("held")), "doc_id"), "quality-train")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((size + 1, size + 2))
        for b in batches:
            phi = features(_matrix(b.column(0)))
            gram += phi.T @ np.column_stack([phi, b.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array([r.tobytes() for r in gram], pa.binary())], names=["row", "part"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows[k] = rows.get(k, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([v.tobytes() for v in rows.values()], pa.binary())], names=["row", "part"])

    parts = arrow_map(train.where("not held").select("x", "y"), sums, "row long, part binary")
    found = collected(arrow_map(parts.repartition("row"), total, "row long, part binary"))
    gram = np.zeros((size + 1, size + 2))
    for r in found:
        gram[r.row] = np.frombuffer(r.part)
    count, positive = gram[-1, -2], gram[-1, -1]
    if not 0 < positive < count:
        return None
    left = gram[:, :-1] / count + ridge * np.diag(np.r_[np.ones(size), 0])
    beta = np.linalg.solve(left, gram[:, -1] / count)
    low, high = -0.5, 1.5

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = features(_matrix(b.column(0))) @ beta
            at = np.clip((s - low) / (high - low) * bins, 0, bins - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(s), b.column(1)], names=["bin", "s", "y"])

    held = collected(arrow_map(train.where("held").select("x", "y"), score, "bin long, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).orderBy("bin"))
    if held:
        knots, values = isotonic(*(np.array([r[k] for r in held], dtype=np.float64) for k in ("s", "n", "p")))
    else:
        knots, values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return Model(features, beta, knots, values)


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text_hash, score): without a model every score is 0.5."""
    if model is None:
        return stats.select("doc_id", "text_hash", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(_matrix(b.column(2))))], names=["doc_id", "text_hash", "score"])

    return arrow_map(stats.select("doc_id", "text_hash", "x"), run, "doc_id long, text_hash long, score double")


def in_fold(doc_id: Column, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, text_hash) for every row of docs.

    Labels are read only for rows outside the held-out fold (crc32 of doc_id mod 3 is 1). Null texts count
    as empty; empty texts are scored like any other, and long texts whole, one at a time. Rows that repeat are each
    returned. A doc_id that is labelled more than once counts with each of its labels; labels other than
    0 and 1, and null ones, do not count. Without usable labels every score is 0.5; an empty table gives no rows. Columns other than the two
    named are not read, whatever their names.
    """
    stats = written(document_statistics(docs, id_col, text_col), "quality-stats", 100)
    seen = labels.where(~in_fold(F.col("doc_id"), 3, 1) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("y"))
    scored = written(score(stats, fit(stats, seen)), "quality-scores", 10_000)
    discard(stats)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_hash")
