import pytest

from dialoom.errors import RuleError
from dialoom.plans import rules as R

TEXT = "Quero cancelar a conta, cobrança indevida indevida"


def run(spark, dsl, **options):
    df = spark.createDataFrame([("s", TEXT, "customer", {"intent_score": 0.7}, {"channel": "voice", "n": "3"})], "source_id string, text string, speaker_role string, features map<string,double>, metadata map<string,string>")
    return R.evaluate(df, [R.compile_rule(dsl, "r")], **options).first()


@pytest.mark.parametrize(
    ("dsl", "matched", "score"),
    [
        ('keyword("COBRANCA")', True, 1), ('word("conta")', True, 1), ('word("cont")', False, 0), ('stem("cancel")', True, 1), ('regex("cobran[cç]a")', True, 1), ('contains_any("x", "conta")', True, 0.5),
        ('contains_all("conta", "x", "y", "quero")', False, 0.5), ("lexical.contains_all([])", True, 0), ('not_contains("zzz")', True, 1), ('excludes_any("conta")', False, 0), ('near("quero", "a", 2)', True, 1), ('near("quero", "conta", 9)', False, 0),
        ('starts_with("quero")', True, 1), ('ends_with("indevida")', True, 1), ('speaker("CUSTOMER")', True, 1), ('speaker != "agent"', True, 1), ('channel("chat")', False, 0), ('field_gte("n", 3)', True, 1), ('field_eq("missing", "x")', False, 0),
        ('repeated("text", "indevida", 4)', False, 0.5), ('occurs_after("text", "quero", "conta")', True, 1), ('intent("x", 0.6)', True, 0.7), ('semantic.intent("x") > 0.7', False, 0.7), ("context.turn_window(3).count(keyword=\"x\") >= 1", False, 0),
        ('NOT keyword("zzz")', True, 1), ('intent("x", 0.6) AND keyword("conta")', True, 0.7), ('keyword("zzz") OR intent("x", 0.6)', True, 0.7),
    ],
)
def test_predicates(spark, dsl, matched, score):
    r = run(spark, dsl)
    assert (r.matched, round(r.score, 6)) == (matched, score)


def test_score_depends_on_what_ran(spark):
    r = run(spark, 'keyword("zzz") AND intent("x", 0.6)')
    assert (r.matched, r.score, r.evaluated, r.short_circuited) == (False, 0.0, 1, True)
    r = run(spark, 'intent("x", 0.6) AND keyword("zzz")', order="declaration")
    assert (r.evaluated, r.score) == (2, 0.0)


def test_evidence(spark):
    r = run(spark, 'stem("cobr") AND near("quero", "a", 2)')
    assert [e.matched_text for e in r.evidence] == ["cobranca", "quero ~ a (dist=2)"]
    assert run(spark, 'NOT keyword("zzz")').evidence == []


def test_block_and_priorities():
    rule = R.compile_rule('RULE billing WHEN keyword("a") THEN tag("x") priority("high") score(0.9)', "r")
    assert (rule.name, rule.tags, rule.priority) == ("billing", ("x",), 10)
    assert R.compile_rule('RULE b WHEN keyword("a") THEN priority(3)', "r").priority == 10


@pytest.mark.parametrize("bad", ["", "keyword(", 'nothing("x")', 'keyword("a") AND', "speaker", 'intent("x", 2)', '"x"', 'keyword("a") keyword("b")'])
def test_errors(bad):
    with pytest.raises(RuleError):
        R.compile_rule(bad, "r")


def test_written_back():
    tree = R.parse('(keyword("a \\"q\\"") OR NOT near("x", "y", 2)) AND speaker == "agent" AND contains_any(["p", "q"])')
    assert R.parse(R.to_dsl(tree)) == tree


@pytest.mark.parametrize(
    "dsl",
    [
        'keyword("a \\"b\\" \\\\ c")', 'word("title", "x")', 'stem("x")', 'regex("a+")', 'not_contains("x")', 'starts_with("x")', 'ends_with("x")', 'contains_any("a", "b")', 'contains_all(["a", "b"])', 'excludes_any("a")', 'near("a", "b", 3)',
        'speaker("agent")', 'speaker != "agent"', 'channel == "voice"', 'field_eq("f", "x")', 'field_gte("f", 3)', 'field_lte("f", 0.00001)', 'repeated("text", "a", 2)', 'occurs_after("text", "a", "b")', 'intent("x")', 'intent("x", 0)', 'intent("x", 0.3)',
        'semantic.intent("x") < 0.3', 'semantic.intent("x") >= 0', 'semantic.similarity("x")', 'semantic.similarity("x") > 0.9', 'similarity("f", "x", 0.0)', 'context.turn_window(5).count(keyword="a", speaker="agent") >= 2', 'context.turn_window(3).any(keyword="a")',
        'lexical.near("a", "b")', 'lexical.word("x")', '(keyword("a") OR NOT word("b")) AND NOT (stem("c") AND regex("d"))',
    ],
)
def test_text_of_a_tree_reads_as_the_tree(dsl):
    tree = R.parse(dsl)
    assert R.parse(R.to_dsl(tree)) == tree


def test_malformed_patterns_are_refused():
    with pytest.raises(RuleError):
        R.compile_rule('regex("a(")', "r")


def test_hangul(spark):
    df = spark.createDataFrame([("s", "주문 취소 요청", "customer", {"x": 0.1}, {"n": "1"})], "source_id string, text string, speaker_role string, features map<string,double>, metadata map<string,string>")
    for dsl in ('keyword("취소")', 'word("취소")', 'stem("취")', 'contains_any("취소", "x")', 'near("주문", "취소", 1)', 'repeated("text", "취소", 1)', 'NOT keyword("취솔")'):
        assert R.evaluate(df, [R.compile_rule(dsl, "r")]).first().matched, dsl
