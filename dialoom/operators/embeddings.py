"""Embeddings by a seeded stand-in or a pluggable encoder, with a table as memo."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags by object type.
TAGS = {"turn": "[TURN]", "context_window": "[WINDOW]", "conversation": "[CONVERSATION]"}


def null_vector(text: str, dimensions: int, normalize: bool = True) -> np.ndarray:
    """The same normal numbers for the same text, and none of its meaning."""
    seed = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    v = np.random.Generator(np.random.PCG64(seed)).standard_normal(dimensions).astype(np.float32)
    size = float(np.linalg.norm(v))
    return v / size if normalize and size else v


def null_embedding(dimensions: int = 384, normalize: bool = True):
    return encoder_udf(lambda: lambda texts: [null_vector(t, dimensions, normalize) for t in texts])


def encoder_udf(load: Callable[[], Callable[[list[str]], list]]):
    """A column function from a loader of encoders, which runs once per task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series(list(encode(texts.fillna("").tolist())))

    return run


def prepared(text: Column, object_type: Column | None = None, prefix: str | None = None) -> Column:
    """Task prefix, tag of the object type, and text, with spaces between."""
    tag = F.coalesce(*[F.when(object_type == k, F.lit(v)) for k, v in TAGS.items()]) if object_type is not None else F.lit(None).cast("string")
    return F.concat_ws(" ", F.lit(prefix).cast("string"), tag, text)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int"))


def with_memo(inputs: DataFrame, memo: DataFrame, embed: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Known vectors from the memo, the rest embedded now."""
    return inputs.join(memo, keys).select(*inputs.columns, "vector").unionByName(embed(inputs.join(memo, keys, "left_anti")).select(*inputs.columns, "vector"))


def encoder_or_null(load: Callable[[], Callable[[list[str]], list]] | None, dimensions: int = 384):
    """(name, column function): the loader's encoder, or the stand-in where there is none or it fails to load here."""
    try:
        if load is not None and callable(load()):
            return "encoder", encoder_udf(load)
    except (ImportError, OSError):
        pass
    return "null", null_embedding(dimensions)
