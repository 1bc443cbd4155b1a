import math

from dialoom.operators import analytics, classification, evaluation, fusion, lexical, vectors


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "ação ação b"), (2, "acao c"), (3, None)], "doc_id int, text string")
    hits = lexical.search(lexical.index(docs), spark.createDataFrame([("q", "Acao acao"), ("none", "!!")], "query_id string, query_text string")).collect()
    idf = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    of = lambda tf, dl: 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (5 / 3)))
    assert [(h.doc_id, h.score) for h in sorted(hits, key=lambda h: h["rank"])] == [(1, round(of(2, 3), 6)), (2, round(of(1, 2), 6))]


def test_fusion(spark):
    side = lambda rows: spark.createDataFrame([("q", *r) for r in rows], "query_id string, rank int, doc_id string, score double")
    a, b = side([(1, "x", 3.0), (2, "y", 1.0)]), side([(1, "y", 0.9)])
    got = [(r.doc_id, r.score) for r in fusion.reciprocal_rank(a, b).orderBy("rank").collect()]
    assert got == [("y", round(1 / 62 + 1 / 61, 6)), ("x", round(1 / 61, 6))]
    assert [(r.doc_id, r.score) for r in fusion.linear(a, b).orderBy("rank").collect()] == [("x", 0.5), ("y", 0.5)]
    assert fusion.hybrid(a, None)[0] == "lexical_only"


def test_zero_vector_and_upsert(spark):
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0])], "doc_id string, vector array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, query_vector array<float>")
    assert [(r.doc_id, r.score) for r in vectors.search(v, q, vectors.VectorConfig(2)).orderBy("rank").collect()] == [("b", 1.0), ("a", 0.0)]


def test_centroids(spark):
    c = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0])], "label string, vector array<double>")
    x = spark.createDataFrame([(1, [1.0, 1.0]), (2, [-1.0, 0.0])], "source_id int, embedding array<float>")
    rows = {r.source_id: r.scores for r in classification.classify_by_centroid(x, c, classification.LabelSpace(("p", "q"))).collect()}
    assert [s.label for s in rows[1]] == ["p", "q"] and rows[2][0].score == 0.0 and rows[1][0].is_positive


def test_ndcg_and_micro_f1(spark):
    hits = spark.createDataFrame([("q", 1, "d2"), ("q", 2, "d1")], "query_id string, rank int, doc_id string")
    judged = spark.createDataFrame([("q", "d1", 3), ("q", "d2", 2), ("z", "d1", 1)], "query_id string, doc_id string, relevance int")
    got = {r.query_id: r for r in evaluation.retrieval(hits, judged, 10).collect()}
    assert round(got["q"].ndcg, 3) == 0.834 and got["z"].ndcg == 0 and got["q"].precision == 0.2
    pairs = spark.createDataFrame([("a", True, True), ("a", True, True), ("b", True, False)], "label string, predicted boolean, truth boolean")
    assert evaluation.micro_macro(evaluation.per_label(pairs)).first().micro_f1 == 0.8


def test_events(spark):
    rows = [("1", "click", 1.0, True, {"k": "a"}, "2026-03-10 12:00:00"), ("2", "view", 3.0, None, {}, "2026-03-11 12:00:00")]
    e = spark.createDataFrame(rows, "event_id string, metric_type string, value double, matched boolean, metadata map<string,string>, ts string")
    e = e.selectExpr("*", "metric_type as event_type", "'s' as source_id", "'turn' as source_type", "cast(null as string) as label").withColumn("ts", e.ts.cast("timestamp"))
    got = {r.group_key: (r.event_count, r.avg_value, r.match_rate) for r in analytics.by_dimension(e, "k").collect()}
    assert got == {"a": (1, 1.0, 1.0), "unknown": (1, 3.0, 0.0)}
    assert analytics.trend(e, "event_count", "weekly").count() == 1
    assert analytics.filter_events(e, analytics.AnalyticsQuery(filters={"k": "a"})).count() == 1
