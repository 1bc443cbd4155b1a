from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as c
from dialoom.llm import mixing, quality

SF = "/root/testdata/sf0.001"
#: Names that the stages use for columns of their own.
CLASHING = "id hash copies text_hash key node row predicted score own doc th pos parts dropped component keep domain tokens p rate u v".split()
ROWS = [(None, None, None, None, None), (None, "", None, None, 0), (5, "", None, "x", 0), (7000, "same text here " * 30, "en", "x", 1), (7000, "same text here " * 30, "en", "x", 1), (7001, "a\n" * 5000, "en", "x", 1), (7002, "word " * 40000, "en", "x", 1)]


def _clashing(df):
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(CLASHING)])


def test_stages(spark):
    """Over the whole table and rows at the edges, each stage with columns of clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.unionByName(spark.createDataFrame(ROWS, docs.schema))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in c.STAGES[:-1]:
        out = c.written(stage(spark, _clashing(before), SF), "test")
        assert out.columns == c.COLUMNS, name
        if name == "quality":
            verdict = {(r.doc_id, r.text_hash): r.predicted for r in quality.quality(before, labels).collect()}
            want = Counter(r.doc_id for r in before.withColumn("h", c._text_hash()).collect() if verdict[r.doc_id, r.h] == 1)
            assert Counter(r.doc_id for r in out.collect()) == want
        if name == "line dedup":
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in before.collect())
            assert out.where("n_chars <> char_length(text)").count() == 0
        if name == "near-dedup":
            assert out.exceptAll(before).count() == 0
        if name == "mixing":
            rated, _ = mixing.mix(before, mixing.language_labels(before, labels))
            assert Counter(r.doc_id for r in out.collect()) == Counter({k: n for k, n in Counter({r.doc_id: r.copies for r in rated.collect()}).items() if n})
        before = out
    pieces = c.STAGES[-1][1](spark, _clashing(before), SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    times = Counter(r.doc_id for r in before.collect())
    whole = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(n * whole[k] for k, n in times.items())
    _gapless(pieces)


def _gapless(pieces):
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= 2048


def test_run(spark):
    """run() over the whole table: no equal line is left in two documents, and what is left is packed."""
    pieces = c.run(spark, SF).collect()
    _gapless(pieces)
    lines = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in c.STAGES[:3]:
        lines = c.written(stage(spark, lines, SF), "test")
    kept = [x.strip().lower() for r in lines.collect() for x in (r.text or "").split("\n") if x.strip()]
    assert len(set(kept)) == len(kept)
    assert {r.doc_id for r in pieces} <= {r.doc_id for r in lines.collect()}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in c.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == c.COLUMNS
