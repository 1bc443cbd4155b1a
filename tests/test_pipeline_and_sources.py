import json
import zipfile

import duckdb
import pytest

import __spark_entry__ as entry
from dialoom import catalog, pipeline
from dialoom.plans.rules import compile_rule
from dialoom.sources import readers
from dialoom.streaming import events as S

SF = "/root/testdata/sf0.001"


def test_files_to_matches(spark, tmp_path):
    (tmp_path / "one.txt").write_text("CUSTOMER: quero cancelar\nAGENT: sim\n")
    result = pipeline.run(readers.transcripts(spark, str(tmp_path / "*.txt")), rules=[compile_rule('word("cancelar")', "r")])
    assert result.turns.count() == 2 and result.rules.count() == 1 and result.events.count() == 1
    config = pipeline.PipelineConfig()
    config.save(str(tmp_path / "c.json"))
    assert pipeline.PipelineConfig.load(str(tmp_path / "c.json")).fingerprint == config.fingerprint


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok.json", json.dumps({"text": "w " * 30}))
        z.writestr("short.json", json.dumps({"text": "w"}))
        z.writestr("bad.json", "{")
        z.writestr("__MACOSX/x.json", "{}")
    rows, counts = readers.zipped_json(spark, str(tmp_path / "a.zip"))
    assert [r.conversation_id for r in rows.collect()] == ["ok"]
    assert {r.reason: r.n for r in counts.collect()} == {"ok": 1, "short": 1, "bad json": 1}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.limit(200).write.parquet(str(tmp_path / "in"))
    source = S.stream(spark, str(tmp_path / "in"), events.schema)
    q = S.trend(source).writeStream.outputMode("complete").format("memory").queryName("trend").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("trend").collect()} == {tuple(r) for r in S.trend(spark.read.parquet(str(tmp_path / "in"))).collect()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["flagship", "turns_merged", "window_metrics", "bm25_stats", "vec_cosine_topk", "rule_near", "rule_metrics", "an_group", "ir_mrr", "clf_micro_macro", "ds_majority", "cat_preview"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "events", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    # Three places: the two engines round halves at the fourth differently.
    norm = lambda rows: sorted(repr([round(float(v), 3) if isinstance(v, float) else v for v in r]) for r in rows)
    want = con.execute(f"select {', '.join(columns)} from ({catalog.SQL[name]})").fetchall()
    assert norm(tuple(r) for r in df.select(columns).collect()) == norm(want)
