"""Text primitives as columns: folding, tokens, counts and features."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Characters of the basic plane that lose a mark and stay one character, and what they become."""
    plane = map(chr, [*range(0x80, 0xAC00), *range(0xE000, 0x10000)])
    pairs = [(c, "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) for c in plane]
    pairs = [(c, d) for c, d in pairs if len(d) == 1 and c != d]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def _jamo(text: Column) -> Column:
    """Hangul syllables as their letters, by the arithmetic of their code points: 19 x 21 x 28 from U+AC00."""
    letters = lambda start, n: F.array(*[F.lit(chr(start + k)) for k in range(n)])
    ends = F.array(F.lit(""), *[F.lit(chr(0x11A8 + k)) for k in range(27)])

    def spelled(c: Column) -> Column:
        k = F.ascii(c) - 0xAC00
        pick = lambda of, i: F.element_at(of, (i + 1).cast("int"))
        return F.when((k >= 0) & (k < 11172), F.concat(pick(letters(0x1100, 19), F.floor(k / 588)), pick(letters(0x1161, 21), F.floor(k % 588 / 28)), pick(ends, k % 28))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), spelled), "")


def fold(text: Column) -> Column:
    """Lower case, then accents dropped, as fold_text does. Stays in the JVM; ASCII is lower-cased only, and only texts with Hangul are taken apart by character."""
    source, target = _accents()
    plain = F.regexp_replace(F.translate(F.lower(text), source, target), r"\p{Mn}+", "")
    whole = F.when(text.rlike("[\uac00-\ud7a3]"), _jamo(plain)).otherwise(plain)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(whole)


def fold_text(text: str) -> str:
    """The same for one string, on the driver."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def words(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Search terms: folded, with all but letters, digits, underscores and white space deleted."""
    return words(F.regexp_replace(fold(text), r"(?U)[^\w\s]", ""))


def normalize(text: Column, unicode_form: bool = False, strip_lines: bool = True, collapse: bool = True) -> Column:
    """Normal form of a turn: optionally NFKC, each line stripped, runs of blanks as one space."""
    out = nfkc(text) if unicode_form else text
    if collapse:
        out = F.regexp_replace(out, r"(?U)[^\S\n]+", " ")
    if strip_lines:
        out = F.array_join(F.transform(F.split(out, "\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")), "\n")
    return out


def turn_features(text: Column) -> dict[str, Column]:
    parts = words(text)
    total = F.aggregate(parts, F.lit(0), lambda a, w: a + F.char_length(w))
    return {
        "char_count": F.char_length(text), "word_count": F.size(parts), "has_question": F.contains(text, F.lit("?")), "line_count": F.size(F.split(text, "\n")),
        "avg_word_length": F.when(F.size(parts) > 0, total / F.size(parts)).otherwise(F.lit(0.0)),
    }


def lexical_features(text: Column) -> dict[str, Column]:
    """Seven numbers for classifiers."""
    parts = words(text)
    total = F.aggregate(parts, F.lit(0), lambda a, w: a + F.char_length(w))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    alpha, chars = count(r"\p{L}"), F.char_length(text).cast("double")
    return {
        "char_count": chars, "word_count": F.size(parts).cast("double"), "avg_word_length": F.when(F.size(parts) > 0, total / F.size(parts)).otherwise(F.lit(0.0)),
        "question_marks": count(r"\?"), "exclamation_marks": count("!"), "uppercase_ratio": F.when(alpha > 0, count(r"\p{Lu}") / alpha).otherwise(F.lit(0.0)),
        "digit_ratio": F.when(chars > 0, count(r"\p{Nd}") / chars).otherwise(F.lit(0.0)),
    }


def structural_features(turn_count: Column, is_customer: Column, is_agent: Column, speakers: Column) -> dict[str, Column]:
    return {"is_customer": is_customer.cast("double"), "is_agent": is_agent.cast("double"), "turn_count": turn_count.cast("double"), "speaker_count": speakers.cast("double")}


def merged(*features: Column) -> Column:
    """Union of feature maps; the last value of a name wins."""
    return F.map_from_entries(F.array_sort(F.flatten(F.array(*[F.map_entries(f) for f in features])))) if len(features) == 1 else _last_wins(features)


def _last_wins(features: tuple[Column, ...]) -> Column:
    out = features[0]
    for f in features[1:]:
        known = F.map_keys(f)
        out = F.map_concat(F.map_filter(out, lambda k, _, known=known: ~F.array_contains(known, k)), f)
    return out


def vector_of(features: Column, names: list[str]) -> Column:
    return F.array(*[F.coalesce(F.element_at(features, F.lit(n)), F.lit(0.0)) for n in names])
