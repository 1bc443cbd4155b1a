"""Toxicity of texts whose words may be disguised: noisy-channel decoding, then a lexicon learned from labels."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, collected, discard, texts_of, written
from dialoom.llm.quality import in_fold

#: Symbols of the language model: 0 is the boundary, 1-26 are letters, 27 is any other letter.
SYMBOLS = 28
ORDER = 4
#: Parts of the labelled rows; a part's features come from a lexicon of the others.
FOLDS = 5
#: Logarithm of the odds above which a term tells.
TELLING = 3.0
#: Which letters a character can stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Log-probabilities of the channel.
SUBSTITUTED, DROPPED, BOUNDARY, SHORTENED = math.log(0.2), math.log(0.3), math.log(0.2), math.log(0.4)
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_RUN, _TWICE = re.compile(r"(.)\1\1"), re.compile(r"(.)\1+")
#: Three or more single characters, one after the other.
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,3}\S(?!\S)){2,}")


def _symbols() -> np.ndarray:
    """The symbol of each code point below 0x250, accents dropped."""
    table = np.zeros(0x250, dtype=np.int64)
    for c in range(0x250):
        base = unicodedata.normalize("NFD", chr(c).lower())[:1]
        table[c] = ord(base) - 96 if "a" <= base <= "z" else 27 if chr(c).isalpha() else 0
    return table


TABLE = _symbols()


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 0x250, TABLE[np.minimum(points, 0x24F)], 27)


def ngram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): how often each run of ORDER symbols occurs in all texts, a boundary at each end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**ORDER, dtype=np.int64)
        for b in batches:
            for text in texts_of(b.column(0)):
                s = np.concatenate(([0] * (ORDER - 1), symbols(text), [0]))
                code = s[: len(s) - ORDER + 1].copy()
                for k in range(1, ORDER):
                    code = code * SYMBOLS + s[k : len(s) - ORDER + 1 + k]
                counts += np.bincount(code, minlength=len(counts)) if len(code) > 20_000 else 0
                if len(code) <= 20_000:
                    np.add.at(counts, code, 1)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["code", "n"])

    return arrow_map(docs.select(F.col(text_col).alias("text")), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log p(symbol | the three before), backed off to shorter contexts; at most SYMBOLS**ORDER rows reach the driver."""
    found = np.zeros(SYMBOLS**ORDER)
    for r in collected(counts):
        found[r.code] = r.n
    n = found.reshape((SYMBOLS,) * ORDER)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(ORDER - 1, -1, -1):
        c = n.sum(axis=tuple(range(k))) if k else n
        p = (c + 2 * p) / (c.sum(axis=-1, keepdims=True) + 2)
    return np.log(p).astype(np.float32).ravel()


def _letter(c: str) -> int:
    return int(TABLE[ord(c)]) if ord(c) < 0x250 else 27 if c.isalpha() else 0


@lru_cache(1 << 16)
def _arcs(c: str, run: int) -> tuple[tuple[float, tuple[tuple[str, int], ...]], ...]:
    """What a run of a character can be: (log-probability, letters with their symbols), a boundary as a space."""
    s = _letter(c)
    if s and run == 1:
        found = [(0.0, c)]
    elif s:
        found = [(SHORTENED if run > 2 else math.log(0.9), c * min(run, 2)), (SHORTENED, c)]
    else:
        found = [(DROPPED, ""), (BOUNDARY, " "), *((SUBSTITUTED, x) for x in LEET.get(c, ""))]
        if run > 1:
            found += [(SUBSTITUTED + SHORTENED, x * 2) for x in LEET.get(c, "")]
    return tuple((cost, tuple((x, 0 if x == " " else _letter(x)) for x in text)) for cost, text in found)


def decode(token: str, model: Sequence[float]) -> str:
    """The likeliest words behind a token: Viterbi over the lattice of what each character can be; exact.

    A letter is itself; a run of a letter can be one or two; a digit or sign can be a letter it resembles,
    nothing, or the end of a word; a space can be nothing or the end of a word. States are the last
    three symbols, all of them are kept, each with a pointer to what was before. What lies before the last point at
    which one state is left is settled and put out, so time and room grow as the token's length.
    """
    cube = SYMBOLS**3
    settled: list[str] = []
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    i, n = 0, len(token)
    while i < n:
        c, j = token[i], i + 1
        while j < n and token[j] == c:
            j += 1
        arcs = _arcs(c, min(j - i, 3))
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, path) in states.items():
            for cost, letters in arcs:
                at, total, way = state, score + cost, path
                for x, y in letters:
                    if y or at % SYMBOLS:  # no boundary after a boundary
                        at = at * SYMBOLS + y
                        total += model[at]
                        at %= cube
                        way = (way, x)
                if (found := new.get(at)) is None or found[0] < total:
                    new[at] = (total, way)
        if len(new) == 1:
            ((at, (_, path)),) = new.items()
            settled.append(_spelled(path))
            new = {at: (0.0, None)}
        states, i = new, j
    best = max((score + (model[at * SYMBOLS] if at % SYMBOLS else 0.0), _spelled(path)) for at, (score, path) in states.items())
    return "".join([*settled, best[1]]).strip()


def _spelled(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def terms(word: str) -> list[str]:
    """What the lexicon knows of a word: itself, and its beginnings of five to eight letters."""
    return [word, *(f"{word[:k]}*" for k in (5, 6, 7, 8) if len(word) >= k)]


class Reader:
    """Words of a text as written, and as decoded where a token looks disguised: one with a sign, a digit or a letter three times in a row.

    A word with letters twice in a row is also read with each of them once; the lexicon learns such readings too.
    """

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def words(self, token: str) -> list[str]:
        core = _TRIM.sub("", token)
        if core.isalpha() and not _RUN.search(core):
            # Leading and trailing signs may belong to the word: '$cum'.
            own = [core, once] if (once := _TWICE.sub(r"\1", core)) != core else [core]
            return own if core == token or not any(c in LEET for c in token) else [*own, *decode(token, self.model).split()]
        if not any(map(str.isalpha, token)) and not any(c in LEET for c in token):
            return []
        return list(dict.fromkeys([core, *decode(token, self.model).split()]))

    def spaced(self, text: str) -> list[str]:
        return [w for m in _SPACED.finditer(text) for w in decode(m[0], self.model).split()]


class Scorer:
    """Features of a text under a lexicon of weighted terms: the largest weight, and the sum over different words."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float]):
        self.reader, self.lexicon, self.known = Reader(model), lexicon, {}

    def weight(self, token: str) -> float:
        return max((self.lexicon.get(t, 0.0) for w in self.reader.words(token) for t in terms(w)), default=0.0)

    def features(self, text: str) -> tuple[float, float]:
        low, known = text.lower(), self.known
        found = []
        for token in set(low.split()):
            w = known.get(token)
            if w is None:
                if len(known) > 600_000:
                    known.clear()
                w = known[token] = self.weight(token)
            if w:
                found.append(w)
        for word in self.reader.spaced(low):
            if w := max(self.lexicon.get(t, 0.0) for t in terms(word)):
                found.append(w)
        return (max(found), math.log1p(sum(found))) if found else (0.0, 0.0)


def _term_sets(batches: Iterator[pa.RecordBatch], model: np.ndarray, only: frozenset[str] | None) -> Iterator[tuple[int, int, set[str]]]:
    """(fold, y, terms) of each text of (fold, y, text); only the terms asked for."""
    reader, known = Reader(model), {}
    asked = (lambda word: terms(word)) if only is None else (lambda word: [t for t in terms(word) if t in only])  # noqa: PLW0108
    for b in batches:
        for fold, y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
            low, seen = text.lower(), set()
            for token in set(low.split()):
                if (t := known.get(token)) is None:
                    if len(known) > 300_000:
                        known.clear()
                    t = known[token] = tuple(x for w in reader.words(token) for x in asked(w))
                seen.update(t)
            for w in reader.spaced(low):
                seen.update(asked(w))
            yield fold, y, seen


def _common(rows: DataFrame, model: np.ndarray, least: int = 3) -> frozenset[str]:
    """The terms that so many texts of rows(fold, y, text) have; bounded, as the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, _, seen in _term_sets(batches, model, None):
            counts.update(seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return frozenset(r.term for r in collected(arrow_map(rows, run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)))


def _counts(rows: DataFrame, model: np.ndarray, only: frozenset[str], sizes: np.ndarray) -> dict[str, np.ndarray]:
    """In how many toxic and other texts, by fold, each of the terms occurs; of terms that tell in no lexicon, none reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], Counter] = {}
        for fold, y, seen in _term_sets(batches, model, only):
            counts.setdefault((fold, y), Counter()).update(seen)
        for (fold, y), c in counts.items():
            columns = ([*c], [fold] * len(c), [1 - y] * len(c), [*c.values()])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["term", "fold", "row", "n"])

    cells = [(row, fold) for row in (0, 1) for fold in range(FOLDS)]
    found = arrow_map(rows, run, "term string, fold long, row long, n long").groupBy("term").agg(
        *[F.coalesce(F.sum(F.when((F.col("row") == row) & (F.col("fold") == fold), F.col("n"))), F.lit(0)).alias(f"n{row}{fold}") for row, fold in cells]
    )
    tells = F.lit(False)
    for without in [*range(FOLDS), None]:
        use = [k for k in range(FOLDS) if k != without]
        bad, good = (sum((F.col(f"n{row}{k}") for k in use), F.lit(0)) for row in (0, 1))
        n = sizes[:, use].sum(axis=1)
        odds = F.log((bad + 0.1) / float(n[0] + 0.2)) - F.log((good + 0.1) / float(n[1] + 0.2))
        tells = tells | ((bad >= 3) & (odds > TELLING - 1e-6))
    return {r.term: np.array([r[f"n{row}{fold}"] for row, fold in cells], dtype=np.float64).reshape(2, FOLDS) for r in collected(found.where(tells))}


def _lexicon(counts: dict[str, np.ndarray], sizes: np.ndarray, without: int | None) -> dict[str, float]:
    """Weights of telling terms; counts and sizes have toxic and other texts by fold, of which one can be left out."""
    use = [k for k in range(FOLDS) if k != without]
    n = sizes[:, use].sum(axis=1)
    out = {}
    for term, by_fold in counts.items():
        bad, good = by_fold[:, use].sum(axis=1)
        if bad >= 3:
            odds = math.log((bad + 0.1) / (n[0] + 0.2)) - math.log((good + 0.1) / (n[1] + 0.2))
            if odds > TELLING:
                out[term] = odds * math.log1p(bad)  # evidence: how telling, and from how many texts
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta)), x.T @ (y - p) - 0.1 * beta)
    return beta


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    The character model counts all texts. The lexicon and the final logistic regression are fitted on
    about `fit_rows` labelled rows outside the held-out fold (crc32 of doc_id mod 5 is 0), chosen by a hash;
    all of them are used where there are fewer. The regression learns from each row's features under a lexicon of
    the other folds' rows; scores use the lexicon of all. Null texts count as empty and are scored like any other, and long texts and
    words whole. Rows that repeat are each returned. A doc_id that is labelled more than once counts with each of its labels; labels other than 0 and 1, and
    null ones, do not count. Without labelled rows of both kinds every score is 0; an empty table gives no rows. Other columns are
    not read, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = language_model(ngram_counts(docs))
    seen = labels.where(~in_fold(F.col("doc_id"), 5, 0) & F.col("toxic").isin(0, 1)).where("doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("y"))
    n = seen.count()
    of = 1_000_000
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(of))
    chosen = seen.where(draw < of * min(1.0, fit_rows / max(n, 1))).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(FOLDS)))
    train = written(docs.join(chosen, "doc_id"), "toxicity-train")
    sizes = np.zeros((2, FOLDS))
    for r in train.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[1 - r.y, r.fold] = r.n
    lexica: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    if sizes.sum(axis=1).all():
        rows = train.select("fold", F.col("y").cast("long"), "text")
        counts = _counts(rows, model, _common(rows.where("y = 1"), model), sizes)
        lexica = [_lexicon(counts, sizes, k) for k in [*range(FOLDS), None]]
    shared = docs.sparkSession.sparkContext.broadcast((model, lexica))

    def features(of_fold: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, lexica = shared.value
            scorers: dict[int, Scorer] = {}
            for b in batches:
                x = np.zeros((b.num_rows, 2))
                folds = b.column(2).to_pylist() if of_fold else [FOLDS] * b.num_rows
                for k, (fold, text) in enumerate(zip(folds, texts_of(b.column(1)), strict=True)):
                    if fold not in scorers:
                        scorers[fold] = Scorer(model, lexica[fold])
                    x[k] = scorers[fold].features(text)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["id", "most", "all"])

        return run

    schema = "id long, most double, all double"
    fitted = collected(arrow_map(train.select(F.col("y").cast("long"), "text", "fold"), features(True), schema)) if lexica[-1] else []
    y = np.array([r[0] for r in fitted], dtype=np.float64)
    held = in_fold(F.col("doc_id"), 5, 0)
    scored = written(arrow_map(docs, features(False), schema), "toxicity-features", 200).withColumnRenamed("id", "doc_id")
    discard(train)
    if 0 < y.sum() < len(y):
        a, b, c = (float(v) for v in _logistic(np.array([[r[1], r[2]] for r in fitted]), y))
        score = 1 / (1 + F.exp(-(F.col("most") * a + F.col("all") * b + c)))
    else:
        score = F.lit(0.0)
    return scored.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
