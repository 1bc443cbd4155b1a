"""More queries of the catalogue: search surface, categories, comparisons, dataset checks; with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom import pipeline
from dialoom.catalog import BM25, CENTROIDS, EVENTS_SQL, RULE_SQL, TERMS, WINDOWS_SQL, _centroid_results, _events, _lexical, _queries, _rule_inputs, _table, _turns, _windows, query
from dialoom.operators import analytics, benchmarks, categories, datasets, lexical, search, segmentation, vectors
from dialoom.plans import rules as R

# ---------------------------------------------------------------- search


@query(f"""WITH {BM25} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY l.rank, doc_id) AS rank, doc_id, score, d.lang AS domain, d.source AS topic, left(d.text, 500) AS preview
    FROM lex l JOIN documents d USING (doc_id) WHERE d.lang = 'en'""")
def search_enriched(spark, d):
    store = _table(spark, d, "documents").select(F.col("doc_id").alias("window_id"), F.col("lang").alias("domain"), F.col("source").alias("topic"), F.left("text", F.lit(search.PREVIEW)).alias("preview"))
    return search.enrich(_lexical(spark, d), store, domain="en", top_k=25)


@query(f"WITH {BM25} SELECT query_id, l.rank, doc_id, 'context_window' AS object_type, d.lang, d.source FROM lex l JOIN documents d USING (doc_id)")
def search_metadata(spark, d):
    hits = search.with_metadata(_lexical(spark, d), _table(spark, d, "documents").select("doc_id", "text", "lang", "source"))
    return hits.select("query_id", "rank", "doc_id", "object_type", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@query(f"""WITH {BM25}, a AS (SELECT query_id, list_distinct({TERMS.format('query_text')}) AS asked FROM queries), t AS (SELECT doc_id, list_distinct({TERMS.format("coalesce(text, '')")}) AS has FROM documents),
    n AS (SELECT query_id, doc_id, l.rank AS old, CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, has)) / len(asked) ELSE 0 END AS s FROM lex l JOIN a USING (query_id) JOIN t USING (doc_id))
    SELECT query_id, rank, doc_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, old, doc_id) AS rank FROM n) WHERE rank <= 10""")
def search_reranked(spark, d):
    return search.rerank(_queries(spark, d), _lexical(spark, d), search.TermCoverage(_table(spark, d, "documents")))


@query(f"""WITH w AS (SELECT doc_id, {TERMS.format('text')} AS w FROM documents) SELECT count(*) AS documents, round(avg(len(w)), 6) AS avg_length, (SELECT count(DISTINCT term) FROM (SELECT unnest(w) AS term FROM w)) AS vocabulary FROM w""")
def bm25_append(spark, d):
    docs = _table(spark, d, "documents")
    both = lexical.index(docs.where("doc_id % 2 = 0")).append(docs.where("doc_id % 2 <> 0 OR doc_id IS NULL"))
    return both.stats.withColumn("avg_length", F.round("avg_length", 6))


@query("SELECT CAST(label AS BIGINT) AS label, i - 1 AS dim, round(max(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL")
def vec_max_pool(spark, d):
    return vectors.pool(_table(spark, d, "embeddings"), "label", "embedding", "max").select("label", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS s FROM e)
    SELECT vec_id, i - 1 AS dim, round(v[i] / s, 6) AS x FROM n, range(1, 65) t(i)""")
def vec_l2_normalize(spark, d):
    e = _table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double")))).alias("dim", "x")).withColumn("x", F.round("x", 6))


def _store(spark, d):
    talks = _table(spark, d, "conversations").groupBy(F.col("conv_id").alias("conversation_id")).agg(F.count(F.lit(1)).alias("turn_count"))
    known = F.when(F.col("conversation_id") % 3 == 0, "billing").when(F.col("conversation_id") % 3 == 1, "support")
    talks = talks.select("conversation_id", known.alias("domain"), F.when(F.col("turn_count") > 5, "long").otherwise("short").alias("topic"), "turn_count", F.when(F.col("conversation_id") % 2 == 0, 0.5).alias("asr_confidence"))
    return search.ConversationStore(talks, _windows(spark, d))


STORE = "c AS (SELECT conv_id AS conversation_id, CASE conv_id % 3 WHEN 0 THEN 'billing' WHEN 1 THEN 'support' ELSE 'unknown' END AS domain, CASE WHEN count(*) > 5 THEN 'long' ELSE 'short' END AS topic, count(*) AS turn_count, CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE 0 END AS asr FROM conversations GROUP BY conv_id)"


@query(f"WITH {STORE} SELECT domain, count(*) AS conversations, round(avg(turn_count), 4) AS avg_turns, CAST(round(avg(asr), 4) AS DOUBLE) AS avg_asr_confidence FROM c GROUP BY 1")
def store_summary(spark, d):
    return _store(spark, d).summary()


@query(f"WITH {STORE} SELECT DISTINCT 'domain' AS facet, domain AS value FROM c UNION SELECT DISTINCT 'topic', topic FROM c")
def store_facets(spark, d):
    return _store(spark, d).facets()


@query(f"""WITH {WINDOWS_SQL}, n AS (SELECT conversation_id, count(*) AS window_count FROM wins GROUP BY 1)
    SELECT conversation_id, count(*) AS turn_count, any_value(window_count) AS window_count, left(string_agg(text, chr(10) ORDER BY ord), 500) AS text_preview, string_agg(speaker, ',' ORDER BY ord) AS speakers FROM turns LEFT JOIN n USING (conversation_id) GROUP BY 1""")
def conversation_view(spark, d):
    turns = _turns(spark, d)
    out = search.conversation_view(turns.select("conversation_id").distinct(), turns, _windows(spark, d))
    return out.select("conversation_id", "turn_count", "window_count", "text_preview", F.array_join(F.transform("turns", lambda t: t["speaker"]), ",").alias("speakers"))


# ---------------------------------------------------------------- categories and rules


_reps = "(length(t) - length(replace(t, 'the', ''))) // 3"


@query(rf"WITH {RULE_SQL} SELECT source_id AS window_id, conversation_id, CAST(1 AS DOUBLE) AS score, CASE WHEN contains(t, 'idiot') THEN 'idiot' ELSE array_to_string(list_filter(w, lambda x: starts_with(x, 'ther')), ', ') END AS matched_text FROM r WHERE contains(t, 'idiot') OR len(list_filter(w, lambda x: starts_with(x, 'ther'))) > 0")
def cat_apply(spark, d):
    return categories.matches(_rule_inputs(spark, d), R.compile_rule('keyword("idiot") OR stem("ther")', "c"))


@query(rf"""WITH {RULE_SQL}, m AS (SELECT conversation_id, CAST(least({_reps} / 32, 1) AS DOUBLE) AS score FROM r WHERE {_reps} >= 1),
    s AS (SELECT count(*) AS n, count(DISTINCT conversation_id) AS k, list(round(score, 4) ORDER BY score) AS l, avg(score) AS mean, count(*) FILTER (WHERE score < 0.05) AS faint FROM m), z AS (SELECT count(*) AS w, count(DISTINCT conversation_id) AS c FROM r),
    p AS (SELECT *, n / w * 100 AS wp, k / c * 100 AS cp, CASE WHEN n > 0 THEN k / n ELSE 0 END AS ratio FROM s, z),
    q AS (SELECT *, 55 + CASE WHEN wp BETWEEN 1 AND 30 THEN 20 WHEN (wp >= 0.5 AND wp < 1) OR (wp > 30 AND wp <= 50) THEN 10 ELSE 0 END + CASE WHEN round(mean, 4) > 0.5 THEN 15 WHEN round(mean, 4) > 0.3 THEN 10 WHEN round(mean, 4) > 0.1 THEN 5 ELSE 0 END
      + CASE WHEN ratio > 0.3 THEN 10 WHEN ratio > 0.1 THEN 5 ELSE 0 END AS a FROM p), f AS (SELECT *, CASE WHEN n = 0 THEN greatest(a - 30, 5) ELSE a END AS b FROM q)
    SELECT n AS matches, k AS conversations, l[1] AS min_score, l[-1] AS max_score, round(mean, 4) AS mean_score, l[n // 2 + 1] AS median_score, l[CAST(floor(n * 0.9) AS BIGINT) + 1] AS p90_score, round(wp, 2) AS window_coverage, round(cp, 2) AS conversation_coverage,
      round(ratio, 4) AS concentration, concat_ws(', ', CASE WHEN n > 0 AND faint / n * 100 > 70 THEN 'many faint scores' END, CASE WHEN wp > 80 THEN 'too broad' WHEN n > 0 AND wp < 0.5 THEN 'too narrow' END, CASE WHEN n > 0 AND ratio < 0.1 THEN 'few conversations' END, CASE WHEN n = 0 THEN 'no matches' END) AS warnings,
      CAST(least(CASE WHEN wp > 80 THEN greatest(b - 20, 10) ELSE b END, 100) AS BIGINT) AS quality FROM f""")
def cat_report(spark, d):
    inputs = _rule_inputs(spark, d)
    out = R.evaluate(inputs, [R.compile_rule('repeated("text", "the", 32) OR repeated("text", "the", 1)', "r")], evidence="always", order="declaration")
    scored = out.where("matched").withColumn("score", F.get("evidence", F.lit(0))["score"])
    size = inputs.agg(F.count(F.lit(1)).alias("w"), F.countDistinct("conversation_id").alias("c")).first()
    return categories.report(scored, size.w, size.c, 2).withColumn("warnings", F.array_join("warnings", ", "))


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT list_transform(range(1, 65), lambda i: CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS qe)
    SELECT vec_id AS source_id, round(list_cosine_similarity(e, qe), 6) AS intent_score FROM v, q""")
def cat_semantic_features(spark, d):
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("source_id"), "embedding")
    out = categories.semantic_features(rows, R.compile_rule('intent("refund", 0.3)', "r"), lambda text: [1.0 if i % 2 == 0 else 0.5 for i in range(1, 65)])
    return out.select("source_id", F.round(F.col("features")["intent_score"], 6).alias("intent_score"))


@query(rf"WITH {RULE_SQL} SELECT source_id, array_to_string(list_filter(['idiot', 'the', 'of'], lambda x: contains(t, x)), '|') AS fragments FROM r WHERE {_reps} >= 2")
def rule_fragments(spark, d):
    out = R.executions(R.evaluate(_rule_inputs(spark, d), [R.compile_rule('contains_any("idiot", "the", "of") AND repeated("text", "the", 2)', "r")]))
    return out.select("source_id", F.array_join(R.fragments(F.col("evidence")), "|").alias("fragments"))


# ---------------------------------------------------------------- comparisons


_RULES = [("a", 'keyword("the") AND word("of")'), ("b", 'contains_any("idiot", "moron") OR stem("ther")'), ("c", 'NOT keyword("tion")')]


@query(rf"""WITH {RULE_SQL}, e AS (SELECT source_id, contains(t, 'the') AS p, regexp_matches(t, '\bof\b') AS q, contains(t, 'idiot') OR contains(t, 'moron') AS u, len(list_filter(w, lambda x: starts_with(x, 'ther'))) > 0 AS v, contains(t, 'tion') AS z FROM r),
    x AS (SELECT source_id, 0 AS o, p AND q AS m, CASE WHEN p THEN 2 ELSE 1 END AS n, 2 AS k, CAST(p AS INT) + CAST(p AND q AS INT) AS g FROM e UNION ALL SELECT source_id, 1, u OR v, CASE WHEN u THEN 1 ELSE 2 END, 2, CASE WHEN u OR v THEN 1 ELSE 0 END FROM e
      UNION ALL SELECT source_id, 2, NOT z, 1, 1, CAST(z AS INT) FROM e),
    y AS (SELECT *, coalesce(sum(CAST(m AS INT)) OVER (PARTITION BY source_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM x),
    s AS (SELECT 'always' AS setting, m, n, k, n AS tests, g FROM y UNION ALL SELECT 'match_only', m, n, k, g, g FROM y UNION ALL SELECT 'first_match', m, n, k, g, g FROM y WHERE earlier = 0)
    SELECT setting, count(*) AS results, count(*) FILTER (WHERE m) AS matched, round(avg(CAST(m AS INT)), 4) AS match_rate, count(*) FILTER (WHERE n < k) AS short_circuited, round(avg(CAST(n < k AS INT)), 4) AS short_circuit_rate,
      CAST(sum(tests) AS BIGINT) AS tests, CAST(sum(g) AS BIGINT) AS tests_matched, CAST(sum(tests) AS BIGINT) AS lexical, CAST(0 AS BIGINT) AS structural, CAST(0 AS BIGINT) AS contextual, CAST(0 AS BIGINT) AS semantic FROM s GROUP BY setting""")
def bench_rules(spark, d):
    settings = {"always": {"evidence": "always"}, "match_only": {}, "first_match": {"mode": "short_circuit"}}
    return benchmarks.rules(_rule_inputs(spark, d), [R.compile_rule(s, n) for n, s in _RULES], settings)


@query(f"""WITH {CENTROIDS}, tr AS (SELECT vec_id AS source_id, CAST(label AS VARCHAR) AS truth FROM embeddings),
    f AS (SELECT method, source_id, label, score >= threshold AS p, label = truth AS t FROM (SELECT *, 'own' AS method, CASE WHEN label = '3' THEN 0.2 ELSE 0.3 END AS threshold FROM sc UNION ALL SELECT *, 'one', 0.25 FROM sc) JOIN tr USING (source_id)),
    ex AS (SELECT method, source_id, count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE t) AS nt, count(*) FILTER (WHERE p AND t) AS b FROM f GROUP BY ALL),
    mm AS (SELECT method, count(*) AS examples, round(avg(CASE WHEN np > 0 THEN b / np ELSE 0 END), 4) AS mean_precision, round(avg(CASE WHEN nt > 0 THEN b / nt ELSE 0 END), 4) AS mean_recall, round(avg(CASE WHEN np + nt > 0 THEN 2 * b / (np + nt) ELSE 0 END), 4) AS mean_f1 FROM ex GROUP BY 1),
    pl AS (SELECT method, label, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM f GROUP BY ALL),
    gl AS (SELECT method, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS micro_f1, round(sum(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) / 11, 4) AS macro_f1 FROM pl GROUP BY 1)
    SELECT * FROM mm JOIN gl USING (method)""")
def bench_classifiers(spark, d):
    truth = _table(spark, d, "embeddings").select(F.col("vec_id").alias("example_id"), F.col("label").cast("string").alias("label"))
    labels = (*[str(i) for i in range(10)], "never")
    results = _centroid_results(spark, d)
    return benchmarks.classifiers({"own": results}, truth, labels).unionByName(benchmarks.classifiers({"one": results}, truth, labels, 0.25))


_SCENARIOS = f"""WITH {EVENTS_SQL}, s AS (SELECT 'types' AS scenario, 'grouped' AS query_type, 3 * count(DISTINCT metric_type) AS group_count, 0 AS trend_point_count FROM e UNION ALL SELECT 'none', 'grouped', 0, 0
    UNION ALL SELECT 'months', 'trend', 0, count(DISTINCT date_trunc('month', ts)) FROM e)"""


def _scenarios(spark, d):
    q = analytics.AnalyticsQuery
    return benchmarks.queries(_events(spark, d), {"types": q(), "none": q(metric_types=("no such type",))}, {"months": (q(), "event_count", "monthly")})


@query(f"{_SCENARIOS} SELECT *, (SELECT count(*) FROM e) AS total_events FROM s")
def bench_analytics(spark, d):
    return _scenarios(spark, d)


@query(f"""{_SCENARIOS} SELECT count(*) AS report_count, round(avg(group_count + trend_point_count), 4) AS avg_result_count, round(avg(CAST(group_count + trend_point_count = 0 AS INT)), 4) AS empty_report_rate,
    round(avg(group_count), 4) AS avg_group_count, round(avg(trend_point_count), 4) AS avg_trend_point_count, CAST(3 * (SELECT count(*) FROM e) AS BIGINT) AS total_events_considered FROM s""")
def an_report_metrics(spark, d):
    return analytics.report_metrics(_scenarios(spark, d).withColumn("generation_time_ms", F.lit(0.0))).drop("avg_generation_time_ms")


@query(f"WITH {EVENTS_SQL} SELECT metric_type, count(*) AS events, count(*) FILTER (WHERE matched) AS matched FROM e GROUP BY 1")
def an_types(spark, d):
    rows = _events(spark, d)
    return analytics.types(analytics.append(rows.where("value >= 10 OR value IS NULL"), rows.where("value < 10")))


LINES = r"""l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
    t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, contains(strip_accents(lower(line)), 'the') AS hit FROM l WHERE trim(line) <> ''),
    st AS (SELECT doc_id, n, unnest(range(0, n, 2)) AS a FROM (SELECT DISTINCT doc_id, n FROM t)), w AS (SELECT st.doc_id, a, bool_or(hit) AS hit FROM st JOIN t ON st.doc_id = t.doc_id AND i BETWEEN a AND a + 4 GROUP BY ALL), z AS (SELECT count(*) AS w, count(*) FILTER (WHERE hit) AS h FROM w)"""


@query(f"""WITH {LINES} SELECT 'text' AS scenario, 'text' AS stage, w AS item_count, false AS skipped FROM z UNION ALL SELECT 'text', unnest(['embedding', 'index', 'classification', 'rules', 'analytics']), 0, true
    UNION ALL SELECT 'full', unnest(['text', 'embedding', 'index']), w, false FROM z UNION ALL SELECT 'full', 'classification', 0, true UNION ALL SELECT 'full', unnest(['rules', 'analytics']), h, false FROM z""")
def bench_pipelines(spark, d):
    none = F.array().cast("array<struct<speaker_label: string, role: string>>")
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("conversation_id"), F.lit("chat").alias("channel"), F.lit("multiline").alias("source_format"), F.coalesce("text", F.lit("")).alias("raw_text"), none.alias("speaker_hints"))
    lines = segmentation.SegmentationConfig(merge_consecutive=False)
    make = lambda **more: lambda: pipeline.run(docs, pipeline.PipelineConfig(segmentation=lines, **{k: v for k, v in more.items() if k != "rules"}), more.get("rules", []))
    rules = [R.compile_rule('keyword("the")', "the")]
    return benchmarks.pipelines(spark, {"text": make(lexical_index=False), "full": make(embedding_dimensions=16, rules=rules)}).drop("elapsed_ms")


# ---------------------------------------------------------------- datasets

WORDS_SQL = r"""lw AS (SELECT lang AS label, unnest(regexp_extract_all(regexp_replace(lower(text), '\[(customer|agent)\]', '', 'g'), '[\p{L}\p{N}\p{M}_]+')) AS word FROM documents), c AS (SELECT label, word, count(*) AS n FROM lw WHERE length(word) > 2 AND word NOT IN (%s) GROUP BY ALL)""" % ", ".join(f"'{w}'" for w in datasets.STOP_WORDS)


def _label_words(spark, d):
    return datasets.label_words(_table(spark, d, "documents"), "lang", "text")


@query(f"""WITH {WORDS_SQL}, u AS (SELECT word, sum(n) AS uses FROM c GROUP BY 1), i AS (SELECT label, sum(n) AS in_label FROM c GROUP BY 1), g AS (SELECT sum(n) AS whole FROM c),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank FROM c) JOIN u USING (word) WHERE rank <= 100 AND uses >= 5), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS place FROM b)
    SELECT label, round(avg((n / in_label) / (uses / whole)), 6) AS exclusivity FROM p JOIN i USING (label), g WHERE place <= 10 GROUP BY label""")
def ds_discrimination(spark, d):
    return datasets.discrimination(_label_words(spark, d)).withColumn("exclusivity", F.round("exclusivity", 6))


@query(f"""WITH {WORDS_SQL}, k AS (SELECT word, count(*) AS in_labels FROM c GROUP BY 1), m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank FROM c),
    o AS (SELECT count(*) AS top_words, count(*) FILTER (WHERE in_labels >= 3) AS shared, round(count(*) FILTER (WHERE in_labels >= 3) / count(*), 4) AS overlap FROM m JOIN k USING (word) WHERE rank <= 20) SELECT * FROM o""")
def ds_overlap(spark, d):
    return datasets.overlap(_label_words(spark, d))


@query("SELECT lang, CASE WHEN avg(n_chars) / 300 > 5 AND 0.1 < 0.2 THEN 'easy' WHEN avg(n_chars) / 300 > 3 THEN 'rather easy' ELSE 'mixed' END AS by_words, CASE WHEN avg(n_chars) / 3000 > 0.9 THEN 'alike' WHEN avg(n_chars) / 3000 > 0.8 THEN 'hard' WHEN avg(n_chars) / 3000 > 0.6 THEN 'moderate' WHEN avg(n_chars) / 3000 < 0.5 THEN 'easy' ELSE 'separated' END AS by_vectors FROM documents GROUP BY 1")
def ds_difficulty(spark, d):
    mean = _table(spark, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("m"))
    return mean.select("lang", datasets.lexical_difficulty(F.col("m") / 300, F.lit(0.1)).alias("by_words"), datasets.vector_difficulty(F.col("m") / 3000, F.lit(3.0)).alias("by_vectors"))


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, round_even(n * 0.7, 0) AS a, round_even(n * 0.15, 0) AS b FROM c),
    s AS (SELECT lang, 'train' AS split, CAST(least(a, n) AS BIGINT) AS n FROM r UNION ALL SELECT lang, 'val', CAST(least(b, n - a) AS BIGINT) FROM r UNION ALL SELECT lang, 'test', CAST(n - a - b AS BIGINT) FROM r)
    SELECT lang, split, n, round(n / sum(n) OVER (PARTITION BY split), 4) AS share FROM s WHERE n > 0""")
def ds_split_counts(spark, d):
    return datasets.split_counts(datasets.split(_table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id"), "lang")


@query("SELECT lang, least(count(*), 5) AS n FROM documents GROUP BY 1")
def ds_draw(spark, d):
    return datasets.draw(_table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 5).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('cancel', CAST(333 AS BIGINT), 333, 'conv_synth_00007', 0), ('praise', 250, 250, 'conv_synth_00340', 250), ('other', 417, 417, 'conv_synth_00590', 0)) t(intent, n, ids, first_id, glad)")
def ds_plan(spark, d):
    p = datasets.plan(spark, 1000, {"cancel": 0.333, "praise": 0.25, "other": 0.4}, {"cancel": {"angry": 0.8, "calm": 0.2}, "praise": {"glad": 1.0}, "": {"calm": 1.0}}, ["bank", "telecom"], ["new", "old"], 7)
    return p.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conversation_id").alias("ids"), F.min("conversation_id").alias("first_id"), F.count_if(F.col("sentiment") == "glad").alias("glad"))
