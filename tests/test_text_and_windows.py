from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import segmentation as S
from dialoom.operators import windows as W

HINTS = "conversation_id string, source_format string, raw_text string, speaker_hints array<struct<speaker_label: string, role: string>>"


def one(df):
    return [tuple(r) for r in df.collect()]


def test_folding(spark):
    cases = ["Ação é ÀÉÎ", "", "naïve Ñ", "áb"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(T.fold(F.col("t"))).collect()] == [T.fold_text(c) for c in cases]


def test_tokens_delete_signs(spark):
    df = spark.createDataFrame([("a-b, C'é  x_1!",)], "t string")
    assert df.select(T.tokens(F.col("t"))).first()[0] == ["ab", "ce", "x_1"]


def test_labelled_text(spark):
    raw = "lost\nCUSTOMER: Hi\nthere\nAGENT:  ok \nAgent: no label\nSYSTEM:\n"
    got = one(S.segment(spark.createDataFrame([("c", "labeled", raw, [])], HINTS)).select("turn_id", "speaker", "raw_text"))
    assert got == [("c_turn_0", "customer", "Hi\nthere"), ("c_turn_1", "agent", "ok \nAgent: no label")]


def test_no_label_is_one_unknown_turn(spark):
    got = one(S.segment(spark.createDataFrame([("c", "labeled", "Customer: hi", [])], HINTS)).select("speaker", "raw_text"))
    assert got == [("unknown", "Customer: hi")]


def test_hints_and_multiline(spark):
    rows = [("a", "labeled", "AGENT: x", [("agent", "customer")]), ("b", "multiline", " x \n\n yy", []), ("c", "plain", "  z ", [])]
    got = {(r.conversation_id, r.idx): (r.speaker, r.raw_text, r.start_offset, r.end_offset) for r in S.segment(spark.createDataFrame(rows, HINTS), S.SegmentationConfig(merge_consecutive=False)).collect()}
    assert got[("a", 0)][0] == "customer"
    assert got[("b", 0)][1:] == ("x", 1, 2) and got[("b", 1)][1:] == ("yy", 6, 8)
    assert got[("c", 0)][1] == "z"


def test_partial_tails(spark):
    turns = spark.createDataFrame([("c", i, "agent", str(i)) for i in range(6)], "conversation_id string, ord int, speaker string, text string")
    assert sorted(r.window_size for r in W.build(turns).collect()) == [2, 4, 5]
    assert [r.window_size for r in W.build(turns, W.WindowConfig(include_partial_tail=False)).collect()] == [5]
    cover = W.coverage(turns, W.build(turns, W.WindowConfig(2, 3))).first()
    assert (cover.total_turns, cover.covered, cover.orphans) == (6, 4, 2)


def test_folding_of_a_whole_plane(spark):
    chars = [chr(c) for c in [*range(0x20, 0xD800, 7), *range(0xAC00, 0xD7A4, 3), *range(0xF900, 0xFFF0)]]
    same = [(c, T.fold_text(c)) for c in chars if len(c.lower()) == 1]
    got = [r[0] for r in spark.createDataFrame([(c,) for c, _ in same], "t string").select(T.fold(F.col("t"))).collect()]
    wrong = [(hex(ord(c)), a, b) for (c, a), b in zip(same, got, strict=True) if a != b]
    assert len(wrong) <= len(same) // 500, wrong[:20]
