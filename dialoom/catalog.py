"""All queries of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import analytics, classification, datasets, embeddings, evaluation, fusion, lexical, segmentation, vectors, windows
from dialoom.plans import rules as R
from dialoom.streaming import events as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as long and fractions as double, as the SQL side has them."""
    to = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select([F.col(f"`{c}`").cast(to[t]).alias(c) if t in to else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: _wide(f(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add


# ---------------------------------------------------------------- shared inputs and their SQL

FOLD = "strip_accents(lower({0}))"
TERMS = r"list_filter(string_split_regex(regexp_replace(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g'), '\s+'), lambda x: x <> '')"
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
TURNS_SQL = """turns AS (SELECT conv_id AS conversation_id, CAST(turn AS BIGINT) AS ord, CASE lower(role) WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' WHEN 'customer' THEN 'customer'
    WHEN 'agent' THEN 'agent' WHEN 'system' THEN 'system' ELSE 'unknown' END AS speaker, coalesce(text, '') AS text FROM conversations)"""
WINDOWS_SQL = (
    TURNS_SQL
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY conversation_id) AS n FROM turns),
    starts AS (SELECT conversation_id, n, unnest(range(0, n, 2)) AS start_index FROM (SELECT DISTINCT conversation_id, n FROM numbered)),
    parts AS (SELECT s.conversation_id, start_index, least(5, s.n - start_index) AS window_size, i, speaker, text FROM starts s JOIN numbered t ON s.conversation_id = t.conversation_id AND i BETWEEN start_index AND start_index + 4),
    wins AS (SELECT conversation_id || '_win_' || (start_index // 2) AS window_id, conversation_id, start_index, start_index + window_size - 1 AS end_index, window_size, 2 AS stride,
      string_agg('[' || upper(speaker) || '] ' || text, chr(10) ORDER BY i) AS window_text FROM parts GROUP BY conversation_id, start_index, window_size)"""
)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.turns_of_chat(_table(spark, d, "conversations"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.build(_turns(spark, d))


def _rule_inputs(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    f = T.lexical_features(F.col("window_text"))
    channel = F.when(F.char_length("window_text") % 3 == 0, "voice").when(F.char_length("window_text") % 3 == 1, "Chat")  # and none
    meta = F.create_map(F.lit("channel"), channel, F.lit("total_chars"), F.char_length("window_text").cast("string"))
    return w.select(
        F.col("window_id").alias("source_id"), "conversation_id", F.col("window_text").alias("text"), datasets.speaker_by_tags(F.col("window_text")).alias("speaker_role"),
        F.create_map(F.lit("intent_score"), f["uppercase_ratio"], F.lit("embedding_similarity"), F.lit(1.0) - f["uppercase_ratio"]).alias("features"), meta.alias("metadata"),
    )


RULE_SQL = WINDOWS_SQL + r""", inputs AS (SELECT window_id AS source_id, conversation_id, window_text, strip_accents(lower(window_text)) AS t,
      len(regexp_extract_all(lower(window_text), '\[customer\]')) AS nc, len(regexp_extract_all(lower(window_text), '\[agent\]')) AS na,
      len(regexp_extract_all(window_text, '\p{L}')) AS alpha, len(regexp_extract_all(window_text, '\p{Lu}')) AS upper_n FROM wins),
    r AS (SELECT *, CASE WHEN nc + na = 0 THEN NULL WHEN nc >= na THEN 'customer' ELSE 'agent' END AS speaker_role, CASE WHEN alpha > 0 THEN upper_n / alpha ELSE 0.0 END AS intent, CASE length(window_text) % 3 WHEN 0 THEN 'voice' WHEN 1 THEN 'Chat' END AS channel,
      list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS w FROM inputs)"""

# ---------------------------------------------------------------- segmentation and windows


@query(
    f"WITH {RULE_SQL} SELECT conversation_id, count(*) AS windows, count(*) FILTER (WHERE contains(t, 'the') AND NOT regexp_matches(t, '\\bidiot\\b')) AS matches FROM r GROUP BY conversation_id",
)
def flagship(spark, d):
    rule = R.compile_rule('keyword("the") AND NOT word("idiot")', "flagship")
    found = R.evaluate(_rule_inputs(spark, d), [rule])
    return found.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if("matched").alias("matches"))


@query(f"""WITH {TURNS_SQL}, kept AS (SELECT * FROM turns WHERE speaker <> 'system'), c AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY conversation_id ORDER BY ord) THEN 0 ELSE 1 END AS ch FROM kept),
    g AS (SELECT *, sum(ch) OVER (PARTITION BY conversation_id ORDER BY ord) AS island FROM c)
    SELECT conversation_id, min(ord) AS ord, min(speaker) AS speaker, string_agg(text, chr(10) ORDER BY ord) AS text FROM g GROUP BY conversation_id, island""")
def turns_merged(spark, d):
    return segmentation.merge_consecutive(_turns(spark, d).where("speaker <> 'system'")).select("conversation_id", "ord", "speaker", "text")


@query(f"""WITH {TURNS_SQL}, w AS (SELECT *, {WORDS.format('text')} AS ws FROM turns)
    SELECT conversation_id, ord, length(text) AS char_count, len(ws) AS word_count, contains(text, '?') AS has_question, len(string_split(text, chr(10))) AS line_count,
      round(CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x))) / len(ws) ELSE 0.0 END, 6) AS avg_word_length FROM w""")
def turn_features(spark, d):
    f = T.turn_features(F.col("text"))
    return _turns(spark, d).select("conversation_id", "ord", *[(F.round(c, 6) if n.startswith("avg") else c).alias(n) for n, c in f.items()])


@query(f"WITH {TURNS_SQL} SELECT conversation_id, ord, text FROM turns WHERE length(text) >= 200")
def turns_long(spark, d):
    return segmentation.filter_short(_turns(spark, d), 200).select("conversation_id", "ord", "text")


@query(f"WITH {WINDOWS_SQL} SELECT window_id, conversation_id, start_index, end_index, window_size, stride FROM wins")
def windows_sliding(spark, d):
    return _windows(spark, d).drop("window_text", "turns")


@query(f"WITH {WINDOWS_SQL} SELECT window_id, window_text FROM wins")
def window_text(spark, d):
    return _windows(spark, d).select("window_id", "window_text")


@query(f"""WITH {WINDOWS_SQL}, m AS (SELECT conversation_id || '_win_' || (start_index // 2) AS window_id, conversation_id, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(sum(len({WORDS.format('text')})) AS BIGINT) AS total_words,
      count(*) FILTER (WHERE speaker = 'customer') AS customer_turns, count(*) FILTER (WHERE speaker = 'agent') AS agent_turns, count(*) FILTER (WHERE speaker = 'system') AS system_turns, count(DISTINCT speaker) AS speaker_count,
      coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (WHERE speaker = 'customer'), '') AS customer_text, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (WHERE speaker = 'agent'), '') AS agent_text FROM parts GROUP BY conversation_id, start_index)
    SELECT *, customer_turns > 0 AS has_customer, agent_turns > 0 AS has_agent FROM m""")
def window_metrics(spark, d):
    return windows.measures(_windows(spark, d))


@query(f"""WITH {WINDOWS_SQL}, hits AS (SELECT conversation_id, i, count(*) AS k FROM parts GROUP BY 1, 2), c AS (SELECT conversation_id, count(*) AS covered, count(*) FILTER (WHERE k > 1) AS overlapping FROM hits GROUP BY 1)
    SELECT conversation_id, total_turns, covered, total_turns - covered AS orphans, overlapping, covered / total_turns AS coverage_ratio FROM (SELECT conversation_id, count(*) AS total_turns FROM turns GROUP BY 1) JOIN c USING (conversation_id)""")
def window_coverage(spark, d):
    return windows.coverage(_turns(spark, d), _windows(spark, d))


@query()
def segment_labeled(spark, d):
    t = _turns(spark, d).groupBy(F.col("conversation_id").cast("string").alias("conversation_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "speaker", "text"))).alias("t"))
    raw = F.array_join(F.transform("t", lambda x: F.concat(F.upper(x["speaker"]), F.lit(": "), x["text"])), "\n")
    hints = F.array().cast("array<struct<speaker_label: string, role: string>>")
    return segmentation.segment(t.select("conversation_id", F.lit("chat").alias("channel"), F.lit("labeled").alias("source_format"), raw.alias("raw_text"), hints.alias("speaker_hints")))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS conversation_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS idx, regexp_replace(line, '^\s+|\s+$', '', 'g') AS raw_text FROM l WHERE trim(line) <> ''""")
def segment_multiline(spark, d):
    none = F.array().cast("array<struct<speaker_label: string, role: string>>")
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("conversation_id"), F.lit("multiline").alias("source_format"), F.coalesce("text", F.lit("")).alias("raw_text"), none.alias("speaker_hints"))
    return segmentation.segment(docs, segmentation.SegmentationConfig(merge_consecutive=False)).select("conversation_id", "idx", "raw_text")


@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def text_fold(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


# ---------------------------------------------------------------- retrieval

PASSAGES = "queries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"
BM25 = (
    PASSAGES
    + f""", d AS (SELECT doc_id, {TERMS.format('text')} AS w FROM documents), p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d), q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TERMS.format('query_text')}) AS term FROM queries) GROUP BY ALL),
    sc AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS raw FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY ALL HAVING raw > 0),
    lex AS (SELECT query_id, rank, doc_id, round(raw, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 25)"""
)


def _queries(spark, d):
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _lexical(spark, d, k=25):
    return lexical.search(lexical.index(_table(spark, d, "documents")), _queries(spark, d), k)


@query(f"WITH {BM25} SELECT query_id, rank, doc_id, score FROM lex WHERE rank <= 10")
def bm25_topk(spark, d):
    return _lexical(spark, d, 10)


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def bm25_df(spark, d):
    return lexical.index(_table(spark, d, "documents")).df


@query(f"WITH d AS (SELECT doc_id, {TERMS.format('text')} AS w FROM documents) SELECT count(*) AS documents, round(avg(len(w)), 6) AS avg_length, (SELECT count(DISTINCT term) FROM (SELECT unnest(w) AS term FROM d)) AS vocabulary FROM d")
def bm25_stats(spark, d):
    return lexical.index(_table(spark, d, "documents")).stats.withColumn("avg_length", F.round("avg_length", 6))


VECTORS = "v AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), vq AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS qe FROM embeddings WHERE vec_id % 50 = 0)"


def _vector_search(spark, d, metric, k=10):
    e = _table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))  # the query set of all searches
    return vectors.search(e.withColumnRenamed("vec_id", "doc_id"), asked, vectors.VectorConfig(64, metric), k, vec_col="embedding")


def _vector_sql(expr: str) -> str:
    return f"WITH {VECTORS}, s AS (SELECT query_id, doc_id, {expr} AS raw FROM v, vq) SELECT query_id, rank, doc_id, round(raw, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM s) WHERE rank <= 10"


for _metric, _expr in (("cosine", "list_cosine_similarity(e, qe)"), ("dot_product", "list_inner_product(e, qe)"), ("l2", "1 / (1 + list_distance(e, qe))")):
    query(_vector_sql(_expr), f"vec_{_metric}_topk")(lambda spark, d, m=_metric: _vector_search(spark, d, m))


@query("""WITH new AS (SELECT vec_id, 1 - label AS label, 0 AS seq FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 100 + label, 1 FROM embeddings WHERE vec_id % 6 = 0),
    last AS (SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY seq DESC) AS k FROM new) WHERE k = 1)
    SELECT vec_id AS source_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM last) UNION ALL SELECT vec_id, label FROM last""")
def vec_upsert(spark, d):
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("source_id"), "label")
    new = e.where("source_id % 3 = 0").select("source_id", (1 - F.col("label")).alias("label"), F.lit(0).alias("seq")).unionByName(e.where("source_id % 6 = 0").select("source_id", (100 + F.col("label")).alias("label"), F.lit(1).alias("seq")))
    return vectors.upsert(e, new)


@query("SELECT CAST(label AS BIGINT) AS label, i - 1 AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL")
def vec_mean_pool(spark, d):
    return vectors.pool(_table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


SIDES = BM25 + f""", {VECTORS}, sem AS (SELECT query_id, rank, doc_id, round(raw, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, list_cosine_similarity(e, qe) AS raw FROM v, vq)) WHERE rank <= 25)"""
RRF = SIDES + """, f AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.doc_id, s.doc_id) AS doc_id, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS raw FROM lex l FULL JOIN sem s ON l.query_id = s.query_id AND l.doc_id = s.doc_id),
    fr AS (SELECT query_id, rank, doc_id, round(raw, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM f) WHERE rank <= 10)"""


def _semantic(spark, d):
    return _vector_search(spark, d, "cosine", 25)


@query(f"WITH {RRF} SELECT * FROM fr")
def fuse_rrf(spark, d):
    return fusion.reciprocal_rank(_lexical(spark, d), _semantic(spark, d)).select("query_id", "rank", "doc_id", "score")


@query(f"""WITH {SIDES}, ln AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM lex WINDOW w AS (PARTITION BY query_id)),
    sn AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM sem WINDOW w AS (PARTITION BY query_id)),
    f AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.doc_id, s.doc_id) AS doc_id, 0.5 * coalesce(l.s, 0) + 0.5 * coalesce(s.s, 0) AS raw FROM ln l FULL JOIN sn s ON l.query_id = s.query_id AND l.doc_id = s.doc_id)
    SELECT query_id, rank, doc_id, round(raw, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def fuse_linear(spark, d):
    return fusion.linear(_lexical(spark, d), _semantic(spark, d)).select("query_id", "rank", "doc_id", "score")


@query(f"""WITH {RRF}, both_q AS (SELECT query_id FROM lex INTERSECT SELECT query_id FROM sem), alone AS (SELECT query_id, doc_id, score FROM lex UNION ALL SELECT query_id, doc_id, score FROM sem)
    SELECT query_id, rank, doc_id, score FROM fr WHERE query_id IN (FROM both_q) UNION ALL
    SELECT query_id, rank, doc_id, round(score, 6) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM alone WHERE query_id NOT IN (FROM both_q)) WHERE rank <= 10""")
def hybrid_search(spark, d):
    return fusion.hybrid(_lexical(spark, d), _semantic(spark, d))[1]


# ---------------------------------------------------------------- rules


def _rule(name: str, dsl: str, matched: str, score: str | None = None) -> None:
    sql = f"WITH {RULE_SQL} SELECT source_id, matched, round(CAST({score or 'CASE WHEN matched THEN 1 ELSE 0 END'} AS DOUBLE), 6) AS score FROM (SELECT *, {matched} AS matched FROM r)"

    def run(spark, d):
        out = R.evaluate(_rule_inputs(spark, d), [R.compile_rule(dsl, name)])
        return out.select("source_id", "matched", F.round("score", 6).alias("score"))

    query(sql, f"rule_{name}")(run)


_has = "CAST(contains(t, '{0}') AS INT)"
_any = " + ".join(_has.format(w) for w in ("idiot", "the", "zzz"))
_reps = "(length(t) - length(replace(t, 'the', ''))) // 3"
_near = "coalesce(list_min(flatten(list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the'), lambda i: list_transform(list_filter(range(1, len(w) + 1), lambda j: w[j] = 'of'), lambda j: abs(i - j))))) <= 3, false)"
for _name, _dsl, *_sql in (
    ("keyword", 'keyword("Thé")', "contains(t, 'the')"),
    ("word", 'word("of")', r"regexp_matches(t, '\bof\b')"),
    ("stem", 'stem("ther")', "len(list_filter(w, lambda x: starts_with(x, 'ther'))) > 0"),
    ("regex", 'regex("th[aeiou]n+")', "regexp_matches(t, 'th[aeiou]n+')"),
    ("contains_any", 'contains_any("idiot", "the", "zzz")', f"({_any}) > 0", f"({_any}) / 3"),
    ("contains_all", 'contains_all(["idiot", "the", "zzz"])', f"({_any}) = 3", f"({_any}) / 3"),
    ("not_contains", 'not_contains("tion")', "NOT contains(t, 'tion')"),
    ("excludes_any", 'excludes_any("idiot", "moron")', "NOT contains(t, 'idiot') AND NOT contains(t, 'moron')"),
    ("near", 'near("the", "of", 3)', _near),
    ("starts_with", 'starts_with("[customer] th")', "starts_with(t, '[customer] th')"),
    ("ends_with", 'ends_with(".")', "ends_with(t, '.')"),
    ("speaker", 'speaker("agent")', "coalesce(speaker_role = 'agent', false)"),
    ("speaker_infix", 'speaker != "customer"', "coalesce(speaker_role <> 'customer', true)"),
    ("channel", 'channel("voice")', "coalesce(channel = 'voice', false)"),
    ("channel_infix", 'channel != "voice"', "coalesce(channel <> 'voice', true)"),
    ("field_eq", 'field_eq("channel", "CHAT")', "coalesce(lower(channel) = 'chat', false)"),
    ("field_gte", 'field_gte("total_chars", 900)', "length(window_text) >= 900"),
    ("field_lte", 'field_lte("total_chars", 900)', "length(window_text) <= 900"),
    ("repeated", 'repeated("text", "the", 4)', f"{_reps} >= 4", f"least({_reps} / 4, 1)"),
    ("occurs_after", 'occurs_after("text", "the", "of")', "instr(t, 'the') > 0 AND instr(t, 'of') > instr(t, 'the')"),
    ("intent", 'intent("x", 0.05)', "intent >= 0.05", "intent"),
    ("similarity", 'semantic.similarity("x") > 0.95', "1 - intent > 0.95", "1 - intent"),
    ("turn_window", 'context.turn_window(5).count(keyword="the") >= 2', "false"),
    ("and_or_not", '(keyword("the") OR word("of")) AND NOT stem("ther")', r"(contains(t, 'the') OR regexp_matches(t, '\bof\b')) AND len(list_filter(w, lambda x: starts_with(x, 'ther'))) = 0"),
    ("score_short_circuit", 'intent("x", 0.03) AND contains_any("idiot", "the", "zzz")', f"({_any}) > 0 AND intent >= 0.03", f"CASE WHEN ({_any}) = 0 THEN 0 ELSE least(({_any}) / 3, intent) END"),
):
    _rule(_name, _dsl, *_sql)

_RULES = [("a", 'keyword("the") AND word("of")'), ("b", 'contains_any("idiot", "moron") OR stem("ther")'), ("c", 'NOT keyword("tion")')]


@query(rf"""WITH {RULE_SQL}, e AS (SELECT source_id, contains(t, 'the') AS p, regexp_matches(t, '\bof\b') AS q, contains(t, 'idiot') OR contains(t, 'moron') AS u, len(list_filter(w, lambda x: starts_with(x, 'ther'))) > 0 AS v, contains(t, 'tion') AS z FROM r),
    x AS (SELECT 'a' AS rule_id, p AND q AS m, CASE WHEN p THEN 2 ELSE 1 END AS n, 2 AS k FROM e UNION ALL SELECT 'b', u OR v, CASE WHEN u THEN 1 ELSE 2 END, 2 FROM e UNION ALL SELECT 'c', NOT z, 1, 1 FROM e)
    SELECT rule_id, count(*) AS evaluations, round(avg(CAST(m AS INT)), 4) AS match_rate, round(avg(CAST(n < k AS INT)), 4) AS short_circuit_rate, CAST(sum(n) AS BIGINT) AS evaluated, CAST(sum(k) AS BIGINT) AS tests FROM x GROUP BY rule_id""")
def rule_metrics(spark, d):
    return R.metrics(R.evaluate(_rule_inputs(spark, d), [R.compile_rule(s, n) for n, s in _RULES]))


@query(rf"""WITH {RULE_SQL}, e AS (SELECT conversation_id, contains(t, 'the') AND regexp_matches(t, '\bof\b') AS a, contains(t, 'idiot') OR contains(t, 'moron') OR len(list_filter(w, lambda x: starts_with(x, 'ther'))) > 0 AS b, NOT contains(t, 'tion') AS c FROM r)
    SELECT CASE WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'c' END AS rule_id, count(*) AS first_matches FROM e WHERE a OR b OR c GROUP BY ALL""")
def rule_first_match(spark, d):
    out = R.evaluate(_rule_inputs(spark, d), [R.compile_rule(s, n) for n, s in _RULES], mode="short_circuit")
    return out.where("matched").groupBy("rule_id").agg(F.count(F.lit(1)).alias("first_matches"))


@query(rf"""WITH {RULE_SQL}, e AS (SELECT source_id, regexp_extract_all(t, '\S+') AS ws FROM r) SELECT source_id, array_to_string(list_filter(ws, lambda x: starts_with(x, 'ther')), ', ') AS matched_text FROM e WHERE len(list_filter(ws, lambda x: starts_with(x, 'ther'))) > 0""")
def rule_evidence(spark, d):
    out = R.executions(R.evaluate(_rule_inputs(spark, d), [R.compile_rule('stem("ther")', "stem")]))
    return out.select("source_id", F.explode("evidence").alias("e")).select("source_id", "e.matched_text")


# ---------------------------------------------------------------- classification


@query(rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS ws FROM documents), n AS (SELECT *, len(regexp_extract_all(t, '\p{{L}}')) AS alpha FROM w)
    SELECT doc_id, CAST(length(t) AS DOUBLE) AS char_count, CAST(len(ws) AS DOUBLE) AS word_count, round(CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x))) / len(ws) ELSE 0 END, 6) AS avg_word_length,
      CAST(len(regexp_extract_all(t, '\?')) AS DOUBLE) AS question_marks, CAST(len(regexp_extract_all(t, '!')) AS DOUBLE) AS exclamation_marks, round(CASE WHEN alpha > 0 THEN len(regexp_extract_all(t, '\p{{Lu}}')) / alpha ELSE 0 END, 6) AS uppercase_ratio,
      round(CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '\p{{Nd}}')) / length(t) ELSE 0 END, 6) AS digit_ratio FROM n""")
def cls_lexical_features(spark, d):
    f = T.lexical_features(F.coalesce("text", F.lit("")))
    return _table(spark, d, "documents").select("doc_id", *[F.round(c, 6).alias(n) for n, c in f.items()])


CENTROIDS = """c0 AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT CAST(label AS VARCHAR) AS label, list(x ORDER BY i) AS v FROM c0 GROUP BY label),
    sc AS (SELECT vec_id AS source_id, c.label, least(1.0, greatest(0.0, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), v))) AS score FROM embeddings, c)"""


def _centroid_results(spark, d):
    e = _table(spark, d, "embeddings")
    space = classification.LabelSpace(tuple(str(i) for i in range(10)), {"3": 0.2}, 0.3)
    return classification.classify_by_centroid(e.select(F.col("vec_id").alias("source_id"), "embedding"), classification.centroids_of(e, vec="embedding"), space)


@query(f"WITH {CENTROIDS} SELECT source_id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(score, 9) DESC, label) AS k FROM sc) WHERE k = 1")
def cls_centroid(spark, d):
    return _centroid_results(spark, d).select("source_id", F.get("scores", F.lit(0)).alias("s")).select("source_id", "s.label", F.round("s.score", 6).alias("score"))


@query(f"WITH {CENTROIDS}, p AS (SELECT *, CASE WHEN label = '3' THEN 0.2 ELSE 0.3 END AS threshold FROM sc) SELECT 'pred_' || left(sha256(source_id || chr(31) || label || chr(31) || 'centroid'), 16) AS prediction_id, source_id, label, round(score, 6) AS score, CAST(threshold AS DOUBLE) AS threshold FROM p WHERE score >= threshold")
def cls_predictions(spark, d):
    return classification.predictions(_centroid_results(spark, d), "centroid").select("prediction_id", "source_id", "label", F.round("score", 6).alias("score"), "threshold")


def _trained(kind):
    def run(spark, d):
        rows = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id")
        f = T.lexical_features(F.coalesce("text", F.lit("")))
        rows = rows.select(F.col("doc_id").alias("source_id"), F.col("quality").cast("string").alias("label"), F.array(*f.values()).alias("features"))
        trained = classification.train(kind, rows)
        return classification.classify_by_model(rows, trained, classification.LabelSpace(("0", "1"))).select("source_id", F.explode("scores").alias("s")).select("source_id", "s.label", "s.score")

    return run


for _kind, _key in (("logistic", "clf_logreg"), ("boosted_trees", "clf_gbt"), ("perceptron", "clf_mlp")):
    query(None, _key)(_trained(_kind))


@query()
def embed_null(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", embeddings.estimated_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), embeddings.null_embedding(16)("text").alias("vector"))


# ---------------------------------------------------------------- analytics

EVENTS_SQL = "e AS (SELECT event_id, ts, event_type AS metric_type, CAST(user_id AS VARCHAR) AS source_id, value, value >= 50 AS matched, json_extract_string(props, '$.k') AS k FROM events)"
_METRICS = "count(*) AS event_count, round(avg(value), 4) AS avg_value, round(avg(CAST(coalesce(matched, false) AS INT)), 4) AS match_rate"


def _events(spark, d):
    return analytics.events_table(_table(spark, d, "events"))


@query(f"WITH {EVENTS_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, metric_type, value FROM e WHERE metric_type IN ('click', 'view', 'purchase') AND ts >= TIMESTAMP '2024-01-01' AND coalesce(k = '3', false)")
def an_filter(spark, d):
    from datetime import datetime

    q = analytics.AnalyticsQuery(metric_types=("click", "view", "purchase"), start_time=datetime(2024, 1, 1), filters={"k": "3"})
    return analytics.filter_events(_events(spark, d), q).select("event_id", "metric_type", "value")


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT coalesce(k, 'unknown') AS group_key, * FROM e), t AS (SELECT group_key, metric_type, row_number() OVER (PARTITION BY group_key ORDER BY count(*) DESC, min(ts), metric_type) AS o FROM g GROUP BY 1, 2)
    SELECT group_key, {_METRICS}, any_value(t.metric_type) AS dominant_type FROM g JOIN t USING (group_key) WHERE o = 1 GROUP BY group_key""")
def an_group(spark, d):
    return analytics.by_dimension(_events(spark, d), "k")


for _window, _unit in analytics.UNITS.items():
    query(f"WITH {EVENTS_SQL} SELECT CAST(strftime(date_trunc('{_unit}', ts), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS bucket, round(avg(value), 4) AS value FROM e GROUP BY 1", f"an_trend_{_window}")(
        lambda spark, d, w=_window: analytics.trend(_events(spark, d), "mean", w).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))
    )


@query(f"WITH {EVENTS_SQL} SELECT {_METRICS}, count(DISTINCT metric_type) AS metric_types FROM e")
def an_stats(spark, d):
    return analytics.stats(_events(spark, d))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT metric_type AS group_key, {_METRICS} FROM e GROUP BY 1), t AS (SELECT strftime(date_trunc('month', ts), '%Y-%m-%dT%H:%M:%S') AS group_key, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY 1)
    SELECT 'types' AS section, group_key, 'event_count' AS metric, CAST(event_count AS DOUBLE) AS value FROM g UNION ALL SELECT 'types', group_key, 'avg_value', avg_value FROM g UNION ALL SELECT 'types', group_key, 'match_rate', match_rate FROM g
    UNION ALL SELECT 'months', group_key, 'event_count', value FROM t""")
def an_composite(spark, d):
    q = analytics.AnalyticsQuery
    return analytics.composite(_events(spark, d), [q("types")], [(q("months"), "event_count", "monthly")])


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type, count(*) AS event_count, round(avg(value), 4) AS avg_value FROM events GROUP BY ALL")
def stream_trend(spark, d):
    return S.trend(_table(spark, d, "events")).select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", "event_count", F.round("avg_value", 4).alias("avg_value"))


@query("""WITH c AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM c)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS event_count FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    return S.sessions(_table(spark, d, "events")).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "event_count")


# ---------------------------------------------------------------- evaluation

TRUTH = "truth AS (SELECT item_id AS query_id, doc_id, CASE WHEN d.lang = 'en' THEN 2 ELSE 1 END AS relevance FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
IR = BM25 + f""", {TRUTH}, f AS (SELECT query_id, count(*) FILTER (WHERE rank <= 10) AS got, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN (2 ** relevance - 1) / log2(rank + 1) END) AS dcg FROM lex JOIN truth USING (query_id, doc_id) GROUP BY 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS rank FROM truth), i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN rank <= 10 THEN (2 ** relevance - 1) / log2(rank + 1) END) AS ideal FROM o GROUP BY 1),
    m AS (SELECT query_id, coalesce(got / relevant, 0) AS recall, coalesce(got / 10.0, 0) AS precision, coalesce(1.0 / first, 0) AS reciprocal_rank, coalesce(dcg / ideal, 0) AS ndcg FROM i LEFT JOIN f USING (query_id))"""


def _judged(spark, d):
    b, docs = _table(spark, d, "benchmark"), _table(spark, d, "documents")
    # Which documents hold a passage: the fixed set of passages against all documents.
    truth = docs.join(F.broadcast(b.withColumnRenamed("text", "passage")), F.contains("text", "passage")).select(F.col("item_id").alias("query_id"), "doc_id", F.when(F.col("lang") == "en", 2).otherwise(1).alias("relevance"))
    return _lexical(spark, d), truth


def _ir(spark, d):
    return evaluation.retrieval(*_judged(spark, d))


@query(f"WITH {IR} SELECT query_id, round(recall, 6) AS recall, round(CAST(precision AS DOUBLE), 6) AS precision FROM m")
def ir_recall_precision(spark, d):
    return _ir(spark, d).select("query_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(f"WITH {IR} SELECT count(*) AS queries, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(reciprocal_rank), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM m")
def ir_mrr(spark, d):
    return evaluation.retrieval_summary(_ir(spark, d))


IR_AT = BM25 + f""", {TRUTH}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS rank FROM truth),
    i AS (SELECT k, query_id, count(*) AS relevant, sum(CASE WHEN rank <= k THEN (2 ** relevance - 1) / log2(rank + 1) END) AS ideal FROM o, ks GROUP BY ALL),
    f AS (SELECT k, query_id, count(*) FILTER (WHERE rank <= k) AS got, min(rank) AS first, sum(CASE WHEN rank <= k THEN (2 ** relevance - 1) / log2(rank + 1) END) AS dcg FROM lex JOIN truth USING (query_id, doc_id), ks GROUP BY ALL)"""


@query(f"""WITH {IR_AT} SELECT k, count(*) AS queries, round(avg(coalesce(got / relevant, 0)), 4) AS recall, round(avg(coalesce(got / CAST(k AS DOUBLE), 0)), 4) AS precision,
    round(avg(coalesce(1.0 / first, 0)), 4) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 4) AS ndcg FROM i LEFT JOIN f USING (k, query_id) GROUP BY k""")
def ir_report(spark, d):
    hits, truth = _judged(spark, d)
    return evaluation.retrieval_report(hits, truth)


@query(f"WITH {IR} SELECT query_id, round(ndcg, 6) AS ndcg FROM m")
def ir_ndcg(spark, d):
    return _ir(spark, d).select("query_id", F.round("ndcg", 6).alias("ndcg"))


# A rule of thumb predicts each label; the sets of labels are compared.
PAIRS = """g AS (SELECT l.doc_id, quality = 1 AS tq, toxic = 1 AS tt, NOT contains(d.text, '!!') AS pq, regexp_matches(lower(d.text), 'idiot|moron') AS pt FROM labels l JOIN documents d USING (doc_id)),
    pairs AS (SELECT doc_id, 'quality' AS label, pq AS predicted, tq AS truth FROM g UNION ALL SELECT doc_id, 'toxic', pt, tt FROM g),
    n AS (SELECT label, count(*) FILTER (WHERE predicted AND truth) AS tp, count(*) FILTER (WHERE predicted AND NOT truth) AS fp, count(*) FILTER (WHERE NOT predicted AND truth) AS fn FROM pairs GROUP BY 1),
    pl AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, tp + fn AS support FROM n)"""


def _label_pairs(spark, d):
    g = _table(spark, d, "labels").join(_table(spark, d, "documents"), "doc_id")
    flags = {"quality": (~F.contains("text", F.lit("!!")), F.col("quality") == 1), "toxic": (F.lower("text").rlike("idiot|moron"), F.col("toxic") == 1)}
    items = [F.struct(F.lit(n).alias("label"), p.alias("predicted"), t.alias("truth")) for n, (p, t) in flags.items()]
    return g.select("doc_id", F.explode(F.array(*items)).alias("x")).select("doc_id", "x.*")


@query(f"WITH {PAIRS} SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pl")
def clf_per_label(spark, d):
    return evaluation.per_label(_label_pairs(spark, d)).select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {PAIRS} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS micro_f1, round(avg(f1), 4) AS macro_f1 FROM pl")
def clf_micro_macro(spark, d):
    return evaluation.micro_macro(evaluation.per_label(_label_pairs(spark, d)))


@query(f"""WITH {PAIRS}, s AS (SELECT doc_id, coalesce(list(label) FILTER (WHERE predicted), []) AS p, coalesce(list(label) FILTER (WHERE truth), []) AS t FROM pairs GROUP BY 1), x AS (SELECT doc_id, len(list_intersect(p, t)) AS b, len(p) AS np, len(t) AS nt FROM s)
    SELECT doc_id AS example_id, CAST(CASE WHEN np > 0 THEN b / np ELSE 0 END AS DOUBLE) AS precision, CAST(CASE WHEN nt > 0 THEN b / nt ELSE 0 END AS DOUBLE) AS recall, round(CASE WHEN b > 0 THEN 2 * b / (np + nt) ELSE 0 END, 6) AS f1 FROM x""")
def clf_set_scores(spark, d):
    p = _label_pairs(spark, d).groupBy("doc_id").agg(F.array_compact(F.collect_list(F.when(F.col("predicted"), F.col("label")))).alias("predicted"), F.array_compact(F.collect_list(F.when(F.col("truth"), F.col("label")))).alias("truth"))
    return evaluation.set_scores(p.withColumnRenamed("doc_id", "example_id")).withColumn("f1", F.round("f1", 6))


@query("SELECT event_type AS stage, round(avg(CASE WHEN value >= 10 THEN value END), 4) AS mean_ms, round(avg(CAST(value < 10 AS INT)), 4) AS skip_rate, round(avg(user_id), 4) AS mean_items, CAST(sum(user_id) AS BIGINT) AS items FROM events GROUP BY 1")
def stage_metrics(spark, d):
    return evaluation.stage_metrics(_table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("elapsed_ms"), F.col("user_id").alias("item_count"), (F.col("value") < 10).alias("skipped")))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def latency_percentiles(spark, d):
    p = evaluation.percentiles(_table(spark, d, "events"), "value")
    return p.select([F.round(c, 6).alias(c) for c in p.columns])


# ---------------------------------------------------------------- datasets and categories


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT sum(n) AS total, max(n) AS most, count(*) AS k FROM c)
    SELECT (SELECT lang FROM c ORDER BY n DESC, lang LIMIT 1) AS majority_label, round(most / total, 4) AS accuracy, round(2 * (most / total) / (1 + most / total) / k, 4) AS macro_f1 FROM s""")
def ds_majority(spark, d):
    return datasets.majority(_table(spark, d, "documents"), "lang")


@query(r"""WITH w AS (SELECT lang AS label, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS word FROM documents), c AS (SELECT label, word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY ALL), t AS (SELECT word, sum(n) AS total FROM c GROUP BY 1 HAVING sum(n) >= 5)
    SELECT label, rank, word, n AS uses, round(n / total, 6) AS exclusivity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n / total DESC, n DESC, word) AS rank FROM c JOIN t USING (word)) WHERE rank <= 20""")
def ds_exclusivity(spark, d):
    return datasets.exclusivity(_table(spark, d, "documents"), "lang", "text")


@query(f"WITH {CENTROIDS} SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM c a JOIN c b ON a.label < b.label")
def ds_separation(spark, d):
    return datasets.separation(classification.centroids_of(_table(spark, d, "embeddings"), vec="embedding"))


@query(f"WITH {CENTROIDS} SELECT c.label, round(avg(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), v)), 6) AS cohesion, count(*) AS n FROM embeddings e JOIN c ON CAST(e.label AS VARCHAR) = c.label GROUP BY 1")
def ds_cohesion(spark, d):
    e = _table(spark, d, "embeddings").select(F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    return datasets.cohesion(e, classification.centroids_of(e))


@query()
def ds_split(spark, d):
    return datasets.split(_table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("""SELECT d.doc_id, CASE WHEN d.lang <> 'fr' THEN d.lang ELSE CASE WHEN l.doc_id IS NOT NULL THEN 'patched' END END AS lang, CASE WHEN d.lang <> 'fr' THEN 'kept' WHEN l.doc_id IS NOT NULL THEN 'patched' ELSE 'missing' END AS patch_state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def ds_backfill(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"))
    return datasets.backfill(docs, _table(spark, d, "labels").select("doc_id", F.lit("patched").alias("lang")), "doc_id", "lang")


@query("SELECT lang, round(avg(n_chars), 4) AS mean_n_chars, round(stddev_pop(n_chars), 4) AS std_n_chars FROM documents GROUP BY 1")
def ds_compare(spark, d):
    c = datasets.compare(_table(spark, d, "documents"), "lang", ["n_chars"])
    return c.select("lang", F.round("mean_n_chars", 4).alias("mean_n_chars"), F.round("std_n_chars", 4).alias("std_n_chars"))


@query("SELECT source, count(*) AS conversations, round(avg(n_chars), 4) AS avg_turns FROM documents GROUP BY 1")
def cat_summary(spark, d):
    return datasets.summary(_table(spark, d, "documents").withColumn("turns", F.col("n_chars")), "source")


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def cat_facets(spark, d):
    return datasets.facet(_table(spark, d, "documents"), "source")


@query(f"""WITH {RULE_SQL}, m AS (SELECT conversation_id, least({_reps} / 4, 1) AS score FROM r WHERE {_reps} >= 2), s AS (SELECT count(*) AS matches, count(DISTINCT conversation_id) AS conversations, list(score ORDER BY score) AS l, avg(score) AS mean_score FROM m)
    SELECT matches, conversations, CAST(l[1] AS DOUBLE) AS min_score, CAST(l[-1] AS DOUBLE) AS max_score, round(mean_score, 4) AS mean_score, CAST(l[matches // 2 + 1] AS DOUBLE) AS median_score, CAST(l[CAST(floor(matches * 0.9) AS BIGINT) + 1] AS DOUBLE) AS p90_score, round(matches / (SELECT count(*) FROM r) * 100, 2) AS coverage_percent FROM s""")
def cat_preview(spark, d):
    inputs = _rule_inputs(spark, d)
    out = R.evaluate(inputs, [R.compile_rule('repeated("text", "the", 4) OR repeated("text", "the", 2)', "r")], evidence="always", order="declaration")
    scored = out.where("matched").withColumn("score", F.get("evidence", F.lit(0))["score"])
    return datasets.preview(scored, inputs.count())


@query(f"WITH {RULE_SQL} SELECT source_id, speaker_role FROM r")
def cat_speaker(spark, d):
    return _rule_inputs(spark, d).select("source_id", "speaker_role")


_ = Window
