"""Soft-membership mixing: domain posteriors from labelled rows, then document rates by projected gradient."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, collected, texts_of, written

BUCKETS = 1 << 14


def _trigrams(text: str) -> np.ndarray:
    """Buckets of a text's character trigrams, with a space at each end."""
    s = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(s) < 3:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = (s[:-2] * np.uint64(0x9E3779B97F4A7C15) + s[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + s[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(50)).astype(np.int64)


def _profiles(train: DataFrame, domains: list[str]) -> np.ndarray:
    """log p(trigram | domain); of domains x BUCKETS counts at most."""
    number = {d: i for i, d in enumerate(domains)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(domains), BUCKETS), dtype=np.int64)
        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                counts[number[d]] += np.bincount(_trigrams(text), minlength=BUCKETS)
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(counts[i, j])], names=["d", "b", "n"])

    n = np.full((len(domains), BUCKETS), 0.5)
    for r in collected(arrow_map(train.select("domain", "text"), run, "d long, b long, n long").groupBy("d", "b").agg(F.sum("n").alias("n"))):
        n[r.d, r.b] += r.n
    return np.log(n / n.sum(axis=1, keepdims=True))


def posteriors(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", evidence: int = 8) -> tuple[list[str], DataFrame]:
    """The domains, and (doc_id, text_hash, tokens, p) for each row of docs: p is its membership of each domain.

    labelled(doc_id, domain) names the domain of some rows. A naive Bayes model of character trigrams
    learns from them; a text counts as `evidence` independent trigrams at most, so that long texts keep
    soft memberships. tokens is the text's bytes over four, one at least. A text without trigrams has the
    labelled rows' shares.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = labelled.where("doc_id is not null and domain is not null").select("doc_id", "domain").distinct()
    shares = {r.domain: r.n for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per domain
    domains = sorted(shares) or ["all"]
    prior = np.log(np.array([shares.get(d, 1) for d in domains], dtype=np.float64) / max(1, sum(shares.values())))
    profile = _profiles(docs.join(labelled, "doc_id"), domains) if shares else np.zeros((1, BUCKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, tokens = np.zeros((b.num_rows, len(domains))), np.zeros(b.num_rows)
            for k, text in enumerate(texts_of(b.column(1))):
                at = _trigrams(text)
                tokens[k] = max(1.0, len(text.encode("utf-8", "surrogatepass")) / 4)
                logit = prior + (profile[:, at].mean(axis=1) * min(len(at), evidence) if len(at) else 0)
                p[k] = np.exp(logit - logit.max())
            p /= p.sum(axis=1, keepdims=True)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(domains)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tokens), flat], names=["doc_id", "text_hash", "tokens", "p"])

    return domains, arrow_map(docs.withColumn("text_hash", F.xxhash64("text")), run, "doc_id long, text_hash long, tokens double, p array<double>")


class Rates:
    """The rates after some accelerated projected-gradient steps, from the steps' residuals alone.

    r starts at one. With y the extrapolated point and e the shortfall at y per domain, a step is
    r' = max(0, y - p.e/L): the gradient in the metric of tokens. A row's rate follows from its own p and
    the list of residuals, so the state between steps is a few numbers on the driver; a lost executor
    costs a recomputation and no more.
    """

    def __init__(self, lipschitz: float):
        self.lipschitz, self.residuals = lipschitz, []

    def __call__(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = y = np.ones(len(p))
        t = 1.0
        for e in self.residuals:
            new = np.maximum(0.0, y - p @ e / self.lipschitz)
            t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            r, y = new, new + (last - 1) / t * (new - r)
        return r, y


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, k)


def fit_rates(member: DataFrame, domains: list[str], weights: dict[str, float] | None = None, temper: float = 0.7, steps: int = 60, close: float = 1e-4) -> tuple[DataFrame, dict]:
    """member with `rate`: the nonnegative rates, near one, whose expected domain token totals match the targets.

    weights are the domains' shares of all tokens; without them each is its present expected share to the
    power `temper`. The total stays as it is. Returns a report beside: totals before, targets, totals
    after, the relative residual and the number of steps.
    """
    k = len(domains)

    def sums(of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k + 2))
            for b in batches:
                p, t = _matrix(b.column(1), k), b.column(0).to_numpy()
                total += of(p, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k + 2)), pa.array(np.tile(np.arange(k + 2), k)), pa.array(total.ravel())], names=["i", "j", "v"])

        out = np.zeros((k, k + 2))
        for r in collected(arrow_map(member.select("tokens", "p"), run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))):
            out[r.i, r.j] = r.v
        return out

    start = sums(lambda p, t: np.column_stack([(p * t[:, None]).T @ p, p.T @ t, np.zeros(k)]))
    now, gram = start[:, k], start[:, :k]
    total = now.sum()
    if not total:
        return member.withColumn("rate", F.lit(1.0)), {"steps": 0}
    share = np.array([weights.get(d, 0.0) for d in domains]) if weights else (now / total) ** temper
    target = share / share.sum() * total
    rates = Rates(float(np.linalg.eigvalsh(gram / total).max()))

    def totals(p, t):
        r, y = rates(p)
        return np.column_stack([np.zeros((k, k)), p.T @ (t * r), p.T @ (t * y)])

    for _ in range(steps):
        found = sums(totals)
        if np.abs(found[:, k] - target).max() <= close * total:
            break
        rates.residuals.append((found[:, k + 1] - target) / total)
    else:
        found = sums(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate, _ = rates(_matrix(b.column(3), k))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate)], names=["doc_id", "text_hash", "tokens", "p", "rate"])

    report = {"domains": domains, "before": now.tolist(), "target": target.tolist(), "after": found[:, k].tolist(), "residual": float(np.abs(found[:, k] - target).max() / total), "steps": len(rates.residuals)}
    return arrow_map(member.select("doc_id", "text_hash", "tokens", "p"), run, "doc_id long, text_hash long, tokens double, p array<double>, rate double"), report


def mix(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, seed: int = 5) -> tuple[DataFrame, dict]:
    """(doc_id, text_hash, tokens, p, rate, copies) for each row of docs, and the report.

    copies is the rate rounded down or up, up with the probability of its fraction, by a hash of the
    row's id and text: the same in every run. Null texts count as empty. Rows that repeat are each
    rated. Without labelled rows there is one domain and every rate is one. An empty table gives no rows.
    """
    domains, member = posteriors(docs, labelled, id_col, text_col)
    rated, report = fit_rates(written(member, "mixing-members"), domains, weights)
    draw = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")), report


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows' languages as domains."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")
