import json

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom import catalog, catalog_services, pipeline, protocols
from dialoom.errors import RuleError, ValidationError
from dialoom.operators import analytics, benchmarks, categories, datasets, embeddings, lexical, search, vectors
from dialoom.plans import rules as R
from dialoom.sources import readers

SF = "/root/testdata/sf0.001"
_ = catalog_services


@pytest.fixture
def inputs(spark):
    rows = [("w1", "c1", "quero cancelar a conta", [1.0, 0.0]), ("w2", "c1", "tudo bem", [0.0, 1.0]), ("w3", "c2", "Cancelar, cancelar", None)]
    return spark.createDataFrame(rows, "source_id string, conversation_id string, text string, embedding array<double>")


def test_categories(spark, tmp_path, inputs):
    store = categories.CategoryStore(spark, str(tmp_path / "cats"))
    assert store.list() == []
    one = store.create("Cancelamento", 'keyword("cancelar")', "those who leave")
    with pytest.raises(ValidationError):
        store.create("CANCELAMENTO", 'keyword("x")')
    with pytest.raises(RuleError):
        store.create("bad", 'keyword("x"')
    with pytest.raises(ValidationError):
        store.create("", 'keyword("x")')
    done = store.apply(one.category_id, inputs)
    assert (done.applied, done.match_count, done.conversation_count) == (True, 2, 2)
    again = categories.CategoryStore(spark, str(tmp_path / "cats"))  # as kept
    assert again.get(one.category_id) == done and [c.name for c in again.list()] == ["Cancelamento"]
    assert {r.window_id for r in again.matches(one.category_id).collect()} == {"w1", "w3"}
    assert again.delete(one.category_id) and not again.delete(one.category_id) and again.list() == []
    with pytest.raises(ValidationError):
        again.apply("cat_none", inputs)


def test_semantic_features_and_reports(inputs):
    rule = R.compile_rule('intent("leaving", 0.5) AND NOT keyword("bem")', "r")
    rows = categories.semantic_features(inputs, rule, lambda text: [1.0, 0.0])
    assert {r.source_id: round(r.f, 6) for r in rows.select("source_id", F.col("features")["intent_score"].alias("f")).collect()} == {"w1": 1.0, "w2": 0.0, "w3": 0.0}
    found = categories.matches(rows, rule)
    assert [r.window_id for r in found.collect()] == ["w1"]
    row = categories.report(found, 3, 2, 2).first()
    assert (row.matches, row.window_coverage, row.concentration, row.quality, row.warnings) == (1, 33.33, 1.0, 50 + 10 + 15 + 10 + 5, [])
    empty = categories.report(found.where("false"), 3, 2, 1).first()
    assert empty.matches == 0 and empty.quality == 20 and empty.warnings == ["no matches"] and empty.median_score is None
    scores = [0.1 * i for i in range(1, 8)]
    many = inputs.sparkSession.createDataFrame([(f"c{i}", s) for i, s in enumerate(scores)], "conversation_id string, score double")
    s = categories.spread(many).first()
    assert (s.median_score, s.p90_score) == (round(scores[3], 4), round(scores[6], 4))


def test_vector_store(spark, tmp_path):
    store = vectors.VectorStore(spark, str(tmp_path / "v"), vectors.VectorConfig(2))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<double>")
    assert store.count() == 0 and store.search(q) is None
    store.upsert(spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.0, 1.0], 0)], "source_id string, vector array<double>, seq int"))
    store.upsert(spark.createDataFrame([("a", [0.0, 2.0], 0), ("a", [1.0, 1.0], 1)], "source_id string, vector array<double>, seq int"))
    assert store.stats() == {"vectors": 2, "dimensions": 2, "metric": "cosine", "index_type": "flat"}
    assert [(r.doc_id, r.score) for r in store.search(q, 2).orderBy("rank").collect()] == [("a", 0.707107), ("b", 0.0)]
    store.clear()
    assert store.count() == 0


def test_index_grows_and_clears(spark):
    docs = spark.createDataFrame([(1, "um dois dois"), (2, "dois"), (3, "três quatro")], "doc_id int, text string")
    grown, whole = lexical.index(docs.where("doc_id < 3")).append(docs.where("doc_id = 3")), lexical.index(docs)
    assert grown.stats.first() == whole.stats.first()
    q = spark.createDataFrame([(0, "dois quatro")], "query_id int, query_text string")
    assert grown.search(q).collect() == whole.search(q).collect()
    assert grown.clear().search(q).count() == 0 and grown.clear().stats.first().documents == 0


def test_run_outputs(spark, tmp_path):
    t = spark.createDataFrame([("c", "chat", "labeled", "CUSTOMER: quero cancelar\nAGENT: sim", None)], "conversation_id string, channel string, source_format string, raw_text string, speaker_hints array<struct<speaker_label: string, role: string>>")
    result = pipeline.run(t, rules=[R.compile_rule('keyword("cancelar")', "r")])
    at = pipeline.save_outputs(spark, result, str(tmp_path), "here", "run_1")
    assert at.endswith("/run_1")
    summary, manifest = json.loads((tmp_path / "run_1/summary.json").read_text()), json.loads((tmp_path / "run_1/manifest.json").read_text())
    assert (summary["turns_count"], summary["windows_count"], summary["embeddings_count"], summary["rule_executions_count"], summary["input_path"]) == (2, 1, 0, 1, "here")
    assert (summary["stages_executed"], summary["stages_skipped"]) == (4, 2)
    assert manifest["fingerprint"] == pipeline.PipelineConfig().fingerprint and manifest["run_id"] == "run_1"
    rows = {(r.scenario, r.stage): r for r in benchmarks.pipelines(spark, {"x": lambda: result}).collect()}
    assert rows["x", "text"].item_count == 1 and rows["x", "embedding"].skipped and rows["x", "rules"].item_count == 1


def test_datasets_are_kept(spark, tmp_path):
    judged = spark.createDataFrame([("q1", "a b", "d1", 2), ("q1", "a b", "d2", 1), ("q2", "c", "d1", 1)], "query_id string, query_text string, doc_id string, relevance int")
    readers.save_judgments(judged, str(tmp_path / "j.json"), "set")
    assert sorted(readers.judgments(spark, str(tmp_path / "j.json")).collect()) == sorted(judged.collect())
    sets = spark.createDataFrame([("e1", "x", ["a", "b"]), ("e2", "y", [])], "example_id string, text string, labels array<string>")
    readers.save_label_sets(sets, str(tmp_path / "l.json"), "set")
    assert sorted(readers.label_sets(spark, str(tmp_path / "l.json")).select(sets.columns).collect()) == sorted(sets.collect())
    rows = spark.createDataFrame([("m1", 0.5), ("m2", 0.25)], "method string, f1 double")
    readers.save_comparison(rows, str(tmp_path / "c"), "method", "set")
    assert json.loads((tmp_path / "c.json").read_text())["results"][1] == {"name": "m2", "figures": {"f1": 0.25}}
    assert (tmp_path / "c.csv").read_text().split() == ["method,f1", "m1,0.5", "m2,0.25"]
    sections = spark.createDataFrame([("s", "a", "event_count", 2.0, "group"), ("t", "2024-01", "event_count", 1.0, "trend")], "section string, group_key string, metric string, value double, kind string")
    readers.save_analytics(sections, str(tmp_path / "r"), "report", analytics.report_metadata(analytics.AnalyticsQuery(), 2, 1.0))
    kept = json.loads((tmp_path / "r.json").read_text())
    assert "filters" not in kept["metadata"] and kept["sections"][0]["grouped_metrics"] == [{"group_key": "a", "metric": "event_count", "value": 2.0}]
    assert len((tmp_path / "r.csv").read_text().split()) == len((tmp_path / "r_trend.csv").read_text().split()) == 2


def test_splits(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 < 2, "big").when(F.col("id") % 2 == 0, "small").alias("label"))  # and none
    ranked = datasets.hash_rank(rows, "label", "id", 42, "at")
    plain = rows.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(42)), "id")).cast("bigint"))
    assert sorted(ranked.select("id", "at").collect()) == sorted(plain.select("id", "at").collect())
    split = datasets.split(rows, "label", "id")
    manifest = datasets.write_splits(split, "label", str(tmp_path / "s"), seed=42)
    assert manifest["total_count"] == 1000 and manifest["train_count"] + manifest["val_count"] + manifest["test_count"] == 1000
    assert json.loads((tmp_path / "s/manifest.json").read_text()) == manifest and manifest["seed"] == 42
    assert datasets.draw(rows, "label", "id", 7).count() == 21


def test_plan_is_the_same_each_time(spark):
    make = lambda n: datasets.plan(spark, 500, {"a": 0.5, "b": 0.5}, {"": {"glad": 0.5, "calm": 0.5}}, ["s"], ["p", "q"], seed=n)
    assert sorted(make(1).collect()) == sorted(make(1).collect()) != sorted(make(2).collect())
    assert 150 < make(1).where("sentiment = 'glad'").count() < 350
    assert datasets.plan(spark, 0, {"a": 1.0}, {}, ["s"], ["p"]).count() == 0


def test_requests_and_fragments(spark):
    with pytest.raises(ValidationError):
        search.SearchRequest("")
    with pytest.raises(ValidationError):
        search.SearchRequest("x", top_k=101)
    assert search.SearchRequest("x" * 500).top_k == 20
    texts = ["a ~ b (dist=2)", "c → d", "e (x3)", "f, g", "a", None]
    rows = spark.createDataFrame([(texts,)], "t array<string>").select(F.transform("t", lambda x: F.struct(x.alias("matched_text"))).alias("e"))
    assert rows.select(R.fragments(F.col("e"))).first()[0] == ["a", "b", "c", "d", "e", "f", "g"]


def test_extension_points(spark, tmp_path):
    docs = spark.createDataFrame([(1, "um dois"), (2, "dois")], "doc_id int, text string")
    assert isinstance(search.TermCoverage(docs), protocols.Reranker)
    assert isinstance(vectors.VectorStore(spark, str(tmp_path), vectors.VectorConfig(2)), protocols.VectorIndex)
    assert isinstance(lexical.index(docs), protocols.LexicalSearcher) and not isinstance(docs, protocols.Reranker)
    assert embeddings.encoder_or_null(None, 4)[0] == "null"

    def missing():
        raise ImportError("no encoder here")

    assert embeddings.encoder_or_null(missing, 4)[0] == "null"
    store = search.ConversationStore(docs.select(F.col("doc_id").alias("conversation_id"), F.lit("x").alias("domain"), F.lit(None).cast("string").alias("topic")), docs.select(F.concat(F.lit("w"), "doc_id").alias("window_id"), F.col("doc_id").alias("conversation_id")))
    assert store.conversation_of("w2").first().conversation_id == 2 and store.window("w9").count() == 0
    assert {tuple(r) for r in store.facets().collect()} == {("domain", "x"), ("topic", "unknown")}


@pytest.mark.parametrize("name", ["search_reranked", "cat_report", "bench_rules", "bench_classifiers", "bench_analytics", "ds_discrimination", "ds_split_counts", "rule_fragments"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "events", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    norm = lambda rows: sorted(repr([round(float(v), 6) if isinstance(v, float) else v for v in r]) for r in rows)
    want = con.execute(f"select {', '.join(columns)} from ({catalog.SQL[name]})").fetchall()
    assert norm(tuple(r) for r in df.select(columns).collect()) == norm(want)
