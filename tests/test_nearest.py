import math
import random
import re

import pytest
from pyspark.sql import functions as F

from dialoom.operators import fusion, lexical, nearest, vectors

SCHEMA = "doc_id string, vector array<double>"


def by_pairs(rows, queries, metric, k):
    """The plain form: every pair scored by a column expression."""
    raw = vectors.score(metric, F.col("v"), F.col("query_vector"))
    pairs = rows.select("doc_id", F.col("vector").alias("v")).crossJoin(queries).select("query_id", "doc_id", raw.alias("raw"))
    return lexical.ranked(pairs, "raw", k)


def same(spark, rows, asked, k=7):
    v = spark.createDataFrame(rows, SCHEMA).repartition(3)
    q = spark.createDataFrame(asked, "query_id long, query_vector array<double>").repartition(2)
    order = lambda df: [(r.query_id, r["rank"], r.doc_id, None if r.score is None else repr(r.score)) for r in df.orderBy("query_id", "rank").collect()]
    for metric in vectors.METRICS:
        got = order(vectors.search(v, q, vectors.VectorConfig(len(rows[0][1]), metric), k))
        assert got == order(by_pairs(v, q, metric, k)), metric


@pytest.mark.parametrize("rows_at_once", [2048, 16])
def test_blocks_equal_all_pairs(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(nearest, "ROWS", rows_at_once)
    monkeypatch.setattr(nearest, "ASKED", 5)
    rng = random.Random(3)
    rows = [(f"d{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(f"c{i}", rows[i % 3][1]) for i in range(60)]  # copies: doc_id decides
    rows += [("zero", [0.0] * 6), ("tiny", [1e-200] * 6), ("small", [1e-12] * 6), ("huge", [1e160] * 6), ("top", [1e308] * 6)]
    same(spark, rows, [(i, rows[i * 7][1]) for i in range(25)] + [(90, [0.0] * 6), (91, [1e-12] * 6), (92, [1e308, -1e308, 1e308, 0.0, 0.0, 1.0])])


def test_numbers_that_are_none_and_null(spark):
    rows = [(f"d{i}", [float(i), 1.0]) for i in range(4)] + [("n", [None, 1.0]), ("m", [None, None]), ("nan", [math.nan, 1.0]), ("inf", [math.inf, 1.0])]
    same(spark, rows, [(1, [1.0, 0.5]), (2, [None, 1.0]), (3, [1.0]), (4, None), (5, [math.nan, 0.0]), (6, [math.inf, 0.0])])
    same(spark, rows[:2], [(1, [1.0, 0.5])], 10)


def test_no_pair_is_scored_by_expression(spark):
    """Products over blocks: the plan holds no row for each pair."""
    v = spark.createDataFrame([("a", [1.0, 0.0])], SCHEMA)
    plan = vectors.search(v, v.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector")), vectors.VectorConfig(2))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_a_search_counts_no_vocabulary(spark):
    ix = lexical.index(spark.createDataFrame([(1, "a b b"), (2, "c")], "doc_id int, text string"))
    assert ix.stats.first().asDict() == {"documents": 2, "avg_length": 2.0, "vocabulary": 3}
    assert "Join" not in ix.stats.select("documents", "avg_length")._jdf.queryExecution().optimizedPlan().toString()
    assert "term" not in ix.stats.select("documents", "avg_length")._jdf.queryExecution().optimizedPlan().toString().replace("terms", "")


def test_scores_are_summed_where_the_document_is(spark):
    """One exchange of postings, by doc_id, and none of (query, document) pairs."""
    ix = lexical.index(spark.createDataFrame([(i, f"a b b w{i}" if i else "c") for i in range(3000)], "doc_id long, text string"))
    hits = lexical.search(ix, spark.createDataFrame([("q", "a b")], "query_id string, query_text string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert [r.doc_id for r in hits.orderBy("rank").collect()] == list(range(1, 11))
    assert [re.sub(r"#\d+L?|, \d+$", "", x) for x in dealt] == ["query_id", "doc_id"], dealt


def test_hybrid_searches_each_side_once(spark, monkeypatch):
    names, kept = [], fusion.kept
    monkeypatch.setattr(fusion, "kept", lambda df, name: names.append(name) or kept(df, name))
    side = lambda q, doc: spark.createDataFrame([(q, 1, doc, 0.5)], "query_id long, rank int, doc_id long, score double").unionByName(spark.createDataFrame([(9, 1, 4, 0.25)], "query_id long, rank int, doc_id long, score double"))
    mode, hits = fusion.hybrid(side(1, 2), side(3, 5))
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in hits.collect())
    assert mode == "hybrid" and got == [(1, 1, 2, 0.5), (3, 1, 5, 0.5), (9, 1, 4, round(2 / 61, 6))]
    assert names == ["hybrid-lexical", "hybrid-semantic"] and "LogicalRDD" not in hits._jdf.queryExecution().optimizedPlan().toString()
