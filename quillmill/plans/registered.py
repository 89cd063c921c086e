"""The registered queries, by inventory id, each beside its DuckDB equivalent."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..operators import evaluation as V
from ..operators import retrieval as R
from ..operators import rows as O
from .catalogue import query, table

AR, AL, LAT = r"\x{0600}-\x{06FF}", r"\x{0621}-\x{064A}", "A-Za-z"
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"


def _n(klass: str, col: str = "text") -> str:
    return f"coalesce(length(regexp_replace({col}, '[^{klass}]+', '', 'g')), 0)"


#: Documents and turns with planted Arabic, broken and foreign characters, questions and repeats: what the driver's lack.
_DOC = "CASE WHEN doc_id % 3 = 0 THEN concat('نص عربي طويل جدا يتكلم عن القانون ', substr(coalesce(text, ''), 1, CAST(doc_id % 60 AS INT))) WHEN doc_id % 3 = 1 THEN concat(text, '\ufffd\u0007\ue000') ELSE text END"
_DOCS = f"(SELECT doc_id, {_DOC} AS text FROM documents)"
_TURN = "CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN concat('جواب بالعربية ديال هاد الدرس اللي قلنا ليك البارح؟ ', substr(text, 1, 8), ' Est-ce clair ? Oui. Et toi?') WHEN role = 'user' AND conv_id % 4 = 1 THEN 'la même question, encore une fois, et toujours la même question' WHEN role = 'assistant' AND conv_id % 4 = 1 THEN concat('la même question, encore une fois, et toujours la même question : ', text) WHEN role = 'user' AND conv_id % 5 = 2 THEN concat(text, ' 漢字') ELSE text END"
_TURNS = f"(SELECT conv_id, turn, role, {_TURN} AS text FROM conversations)"


def _docs(spark, sf):
    return table(spark, sf, "documents").withColumn("text", F.expr(_DOC))


def _talk(spark, sf):
    return table(spark, sf, "conversations").withColumn("text", F.expr(_TURN))


# ---- B: text -------------------------------------------------------------------------------------------------


@query("b2_doc_language", f"SELECT doc_id, CASE WHEN {_n(AR)} > {_n(LAT)} THEN 'ar' ELSE 'fr' END AS doc_lang FROM " + _DOCS)
def b2(spark, sf):
    return _docs(spark, sf).select("doc_id", T.detect_doc_lang(F.col("text")).alias("doc_lang"))


@query("b3_arabic_source", f"SELECT doc_id, {_n(AL)} > 0.15 * {_n(LAT)} AS is_arabic FROM " + _DOCS)
def b3(spark, sf):
    return _docs(spark, sf).select("doc_id", T.is_arabic_doc(F.col("text")).alias("is_arabic"))


@query("b12_target_script", "SELECT conv_id, turn, CASE WHEN " + _n(r"\x{0621}-\x{06FF}") + f" > {_n(LAT)} THEN 'arabic' ELSE 'arabizi' END AS script FROM {_TURNS} WHERE role = 'assistant'")
def b12(spark, sf):
    return _talk(spark, sf).where("role = 'assistant'").select("conv_id", "turn", T.target_script(F.col("text")).alias("script"))


@query("b16_arabic_majority", rf"SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '[{AR}]'))) > len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]'))) AS arabic_words FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+') AS w FROM {_DOCS})")
def b16(spark, sf):
    return _docs(spark, sf).select("doc_id", T.arabic_majority(F.col("text")).alias("arabic_words"))


@query("b17_oov_characters", "SELECT c AS ch, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' AND NOT regexp_matches(c, '[A-Za-z0-9 .,\n]') GROUP BY c")
def b17(spark, sf):
    allowed = spark.createDataFrame([(c,) for c in string.ascii_letters + string.digits + " .,\n"], "ch string")
    return O.oov_characters(table(spark, sf, "documents"), allowed)


@query("b18_bad_char_ratio", "SELECT doc_id, " + _n(r"\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x{E000}-\x{F8FF}") + " / greatest(length(text), 1)::DOUBLE AS bad_ratio FROM " + _DOCS)
def b18(spark, sf):
    return _docs(spark, sf).select("doc_id", T.bad_char_ratio(F.col("text")).alias("bad_ratio"))


@query("b19_ocr_incomplete", "SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '[0-9]+[.,][0-9]+|[0-9]{4,}') AS incomplete FROM documents")
def b19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.ocr_incomplete(F.col("text")).alias("incomplete"))


_RENDER = """WITH s AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system') AS sys FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role <> 'system')
SELECT s.conv_id AS row_id, md5(coalesce(string_agg('<start_of_turn>' || CASE WHEN role = 'assistant' THEN 'model' ELSE role END || chr(10) || CASE WHEN i = 1 AND coalesce(sys, '') <> '' THEN sys || chr(10) || chr(10) ELSE '' END || trim(text) || '<end_of_turn>' || chr(10), '' ORDER BY turn), '')) AS rendered_md5
FROM s LEFT JOIN t ON s.conv_id = t.conv_id GROUP BY s.conv_id"""


def _rows(spark, sf):
    return O.rows_from_turns(table(spark, sf, "conversations"))


@query("b22_render_rows", _RENDER)
def b22(spark, sf):
    return _rows(spark, sf).select("row_id", F.md5(T.render_rows(F.col("messages"))).alias("rendered_md5"))


# ---- C: ingest -----------------------------------------------------------------------------------------------


def _files(spark, sf):
    """orders as a file registry: F is ready, P partial, O pending."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "P", "partial").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tenant_id"), status.alias("status"), (F.col("o_orderkey") % 2 == 1).alias("enabled"), F.col("o_orderdate").alias("created_at"))


_FILES = "f AS (SELECT o_orderkey AS id, o_custkey AS tenant_id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'P' THEN 'partial' ELSE 'pending' END AS status, o_orderkey % 2 = 1 AS enabled, o_orderdate AS created_at FROM orders)"


@query("c5_domain_classes", "SELECT source AS domain, CASE WHEN bool_and(lang = 'en' OR length(source) % 2 = 0) THEN 'generalization' ELSE 'client' END AS scope_class FROM documents GROUP BY source")
def c5(spark, sf):
    scope = F.when((F.col("lang") == "en") | (F.length("source") % 2 == 0), "generalization").otherwise("client")
    return I.classify_domains(table(spark, sf, "documents").select(F.col("source").alias("domain"), scope.alias("scope")))


@query("c7_append_chunks", """WITH h AS (SELECT doc_id, sha256(concat_ws('|', lang, source, text)) AS content_hash, lang FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, content_hash ORDER BY doc_id) AS p FROM h WHERE doc_id % 3 > 0 AND (lang, content_hash) NOT IN (SELECT (lang, content_hash) FROM h WHERE doc_id % 3 = 0))
SELECT doc_id, content_hash FROM n WHERE p = 1""")
def c7(spark, sf):
    d = table(spark, sf, "documents")
    hashed = d.select(F.col("doc_id").alias("ord"), F.col("lang").alias("tenant_id"), I.content_hash(F.col("lang"), F.col("source"), F.col("text")).alias("content_hash"))
    return I.append_chunks(hashed.where("ord % 3 > 0"), hashed.where("ord % 3 = 0")).select(F.col("ord").alias("doc_id"), "content_hash")


@query("c8_match_uploads", """WITH d AS (SELECT doc_id, lang, sha256(text) AS h FROM documents), r AS (SELECT lang, h, min(doc_id) AS duplicate_of FROM d WHERE doc_id % 4 IN (0, 1) GROUP BY lang, h)
SELECT d.doc_id, r.duplicate_of FROM d LEFT JOIN r ON d.lang = r.lang AND d.h = r.h WHERE doc_id % 4 = 3""")
def c8(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tenant_id"), F.sha2("text", 256).alias("sha256"), F.element_at(F.array(F.lit("ready"), F.lit("partial"), F.lit("error"), F.lit("new")), (F.col("doc_id") % 4 + 1).cast("int")).alias("status"))
    return I.match_uploads(d.where("status = 'new'"), d).select(F.col("id").alias("doc_id"), "duplicate_of")


@query("c11_source_catalogue", "WITH " + _FILES + """, l AS (SELECT l_orderkey AS id, count(*) AS n_chunks FROM lineitem GROUP BY 1), j AS (SELECT f.*, coalesce(l.n_chunks, 0) AS n_chunks FROM f LEFT JOIN l USING (id))
SELECT tenant_id, count(*) AS n_files, count(*) FILTER (status <> 'pending') AS n_ready, CAST(sum(CASE WHEN status <> 'pending' THEN n_chunks ELSE 0 END) AS BIGINT) AS n_chunks, arg_max(id, (created_at, id)) AS newest FROM j GROUP BY tenant_id""")
def c11(spark, sf):
    chunks = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n_chunks"))
    return I.source_catalogue(_files(spark, sf).join(chunks, "id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))))


@query("c12_delete_source", "SELECT l_orderkey AS source_id, count(*) AS deleted FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def c12(spark, sf):
    ids = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source_id"))
    return I.delete_source(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "source_id"), ids)[1]


@query("c13_status_events", """WITH e AS (SELECT event_id, ts, user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'error' ELSE 'processing' END AS status, event_type = 'purchase' AND value < 50 AS no_url, event_type = 'error' AND value < 20 AS no_msg FROM events)
SELECT job_id, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS p FROM e WHERE NOT no_url AND NOT no_msg) WHERE p = 1""")
def c13(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "job_id")
    e = e.withColumn("status", F.when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "error", "error").otherwise("processing"))
    e = e.withColumn("url", F.when(F.col("value") >= 50, "u")).withColumn("message", F.when(F.col("value") >= 20, "m"))
    return I.apply_status_events(e)[0].select("job_id", "status", "event_id")


@query("c14_reap_orphans", "WITH " + _FILES + " SELECT CASE WHEN status = 'pending' AND tenant_id = 7 THEN 'error' ELSE status END AS status, count(*) AS n FROM f GROUP BY 1")
def c14(spark, sf):
    return I.reap_orphans(_files(spark, sf).withColumn("message", F.lit(None).cast("string")), 7).groupBy("status").agg(F.count("*").alias("n"))


@query("c15_corpus_version", "WITH " + _FILES + " SELECT tenant_id, sha256(string_agg(id || ':' || enabled::VARCHAR, '|' ORDER BY id) || '|n=' || count(*)) AS version FROM f WHERE status <> 'pending' GROUP BY tenant_id")
def c15(spark, sf):
    return I.corpus_version(_files(spark, sf))


@query("d6_active_sources", "WITH " + _FILES + " SELECT tenant_id, id FROM f WHERE status <> 'pending' AND enabled")
def d6(spark, sf):
    return I.active_sources(_files(spark, sf))


# ---- D, K: retrieval -----------------------------------------------------------------------------------------

_SIMS = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id AS chunk_id, c.label AS domain, list_cosine_similarity(q.e, c.e) AS similarity FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id{extra}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 10) DESC, chunk_id) AS rank FROM s)"""


def _chunks(spark, sf):
    e = table(spark, sf, "embeddings")
    uploaded = F.when(F.col("vec_id") % 7 == 0, F.col("vec_id").cast("string"))
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("domain"), uploaded.alias("source_file_id"))


def _near(spark, sf, k, filtered=False):
    e = table(spark, sf, "embeddings").where("vec_id % 20 = 0")
    domain = F.col("label") if filtered else F.lit(None).cast("int")
    return R.top_k(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), domain.alias("domain")), _chunks(spark, sf), k)


def _queries(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold"))


@query("d1_top_k", _SIMS.format(extra=" AND (c.label = q.label OR c.vec_id % 7 = 0)") + " SELECT query_id, chunk_id, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 5")
def d1(spark, sf):
    return _near(spark, sf, 5, filtered=True).select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


_AFF = _SIMS.format(extra="") + """, c AS (SELECT *, domain % 2 = query_label % 2 AS same, count(*) FILTER (domain % 2 = query_label % 2) OVER (PARTITION BY query_id) AS n_same FROM r WHERE rank <= 20 AND similarity >= 0.1),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n_same >= 5 AND NOT same THEN 1 ELSE 0 END, rank) AS place FROM c)
SELECT query_id, chunk_id, place, bool_or(NOT same) OVER (PARTITION BY query_id) AS cross_language FROM p WHERE place <= 5"""


@query("d3_select_affinity", _AFF)
def d3(spark, sf):
    cands = _near(spark, sf, 20).join(_queries(spark, sf), "query_id").withColumn("language", F.col("domain") % 2).withColumn("target_language", F.col("gold") % 2)
    return R.select_affinity(cands, 5, 0.1).select("query_id", "chunk_id", "place", "cross_language")


_VOTE = _SIMS.format(extra="") + """, w AS (SELECT query_id, domain, sum(similarity) AS votes, min(rank) AS best FROM r WHERE rank <= 20 AND similarity >= 0.2 GROUP BY 1, 2),
t AS (SELECT query_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, best) AS p FROM w) WHERE p = 1)"""


@query("d7_vote_domain", _VOTE + " SELECT query_id, domain FROM t")
def d7(spark, sf):
    return R.vote_domain(_near(spark, sf, 20), 0.2)


_RESOLVED = _VOTE + """, q AS (SELECT vec_id AS query_id, label AS gold, CASE WHEN vec_id % 60 = 0 THEN label END AS explicit FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT q.query_id, gold, coalesce(explicit, t.domain, -1) AS domain, CASE WHEN explicit IS NOT NULL THEN 'page_context' WHEN t.domain IS NOT NULL THEN 'retrieval' ELSE 'no_match' END AS domain_source FROM q LEFT JOIN t USING (query_id))"""


def _resolved(spark, sf):
    q = _queries(spark, sf).withColumn("domain", F.when(F.col("query_id") % 60 == 0, F.col("gold")))
    return R.resolve_domain(q, R.vote_domain(_near(spark, sf, 20), 0.2), -1).join(_queries(spark, sf), "query_id")


@query("d8_resolve_domain", _RESOLVED + " SELECT query_id, domain, domain_source FROM x")
def d8(spark, sf):
    return _resolved(spark, sf).select("query_id", "domain", "domain_source")


@query("d9_refusal", _RESOLVED + " SELECT query_id, domain_source = 'no_match' OR query_id % 40 = 0 AS refused, CASE WHEN domain_source = 'no_match' AND query_id % 40 = 0 THEN 'both' WHEN domain_source = 'no_match' THEN 'no_match_only' WHEN query_id % 40 = 0 THEN 'empty_only' ELSE 'none' END AS trigger FROM x")
def d9(spark, sf):
    return R.refusal(_resolved(spark, sf).withColumn("context_chars", F.when(F.col("query_id") % 40 == 0, 0).otherwise(10))).select("query_id", "refused", "trigger")


@query("k1_retrieval_score", _SIMS.format(extra="") + ", g AS (SELECT query_id, min(rank) FILTER (domain = query_label) AS f FROM r WHERE rank <= 4 GROUP BY 1) SELECT count(*) AS n, round(count(f) / count(*)::DOUBLE, 6) AS recall, round(sum(coalesce(1.0 / f, 0)) / count(*), 6) AS mrr FROM g")
def k1(spark, sf):
    q = _queries(spark, sf)
    cands = _near(spark, sf, 4).join(q, "query_id").withColumn("is_gold", F.col("domain") == F.col("gold"))
    return R.score_retrieval(cands, q).select("n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("k2_routing_accuracy", _RESOLVED + " SELECT count(*) AS n, round(avg((domain = gold)::INT), 6) AS accuracy FROM x WHERE domain_source <> 'page_context'")
def k2(spark, sf):
    return V.routing_accuracy(_resolved(spark, sf))


@query("k4_threshold_sweep", _SIMS.format(extra="") + """, h AS (SELECT unnest([0.0, 0.2, 0.4, 0.6]) AS threshold), w AS (SELECT threshold, query_id, domain, sum(similarity) AS votes, min(rank) AS best FROM r JOIN h ON similarity >= threshold WHERE rank <= 20 GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY threshold, query_id ORDER BY votes DESC, best) AS p FROM w), q AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 20 = 0)
SELECT h.threshold, count(*) AS n, count(t.domain) AS n_voted, count(*) FILTER (t.domain = q.label) AS n_right FROM q CROSS JOIN h LEFT JOIN t ON t.query_id = q.query_id AND t.threshold = h.threshold AND p = 1 GROUP BY 1""")
def k4(spark, sf):
    return R.threshold_sweep(_near(spark, sf, 20), _queries(spark, sf), (0.0, 0.2, 0.4, 0.6))


@query("k6_engine_summary", "SELECT user_id AS engine, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_value FROM events GROUP BY user_id")
def k6(spark, sf):
    ok = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("engine")).agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("n_failed"), F.round(F.avg(ok), 6).alias("mean_value"))


@query("k12_quota_sample", "SELECT doc_id, lang, place, lang || '-' || place AS sample_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents WHERE trim(text) <> '') WHERE place <= 12")
def k12(spark, sf):
    return V.quota_sample(table(spark, sf, "documents").where(F.trim("text") != ""), "lang", "doc_id", 12).select("doc_id", "lang", "place", "sample_id")


# ---- E, F, G: conversations ----------------------------------------------------------------------------------


@query("e2_dropped_questions", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM " + _TURNS + r""" WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^.!?\x{061F}]*[.!?\x{061F}]|[^.!?\x{061F}]+')) AS q FROM a WHERE age > 2) SELECT conv_id, turn, trim(q, ' ') AS question FROM s WHERE regexp_matches(q, '[?\x{061F}]')""")
def e2(spark, sf):
    return O.dropped_questions(_talk(spark, sf))


_PLANTED = f"WITH c AS (SELECT conv_id AS row_id, turn, role, coalesce(text, '') AS text FROM {_TURNS})"
_TEXTS = "WITH c AS (SELECT conv_id AS row_id, turn, role, coalesce(text, '') AS text FROM conversations)"


@query("f5_valid_chatml", _TEXTS + rf""" SELECT row_id, bool_or(role = 'user') AND bool_or(role = 'assistant') AND bool_and(trim(text) <> '') AND coalesce(bool_and(length(regexp_replace(text, '[^A-Za-z0-9\x{{00C0}}-\x{{024F}}\x{{0600}}-\x{{06FF}}]+', '', 'g')) >= 4 AND NOT regexp_matches(text, '[{CJK}]')) FILTER (role <> 'system'), true) AS valid FROM c GROUP BY row_id""")
def f5(spark, sf):
    return _rows(spark, sf).select("row_id", O.valid_chatml(F.col("messages")).alias("valid"))


@query("f9_structural_problems", _TEXTS + """, t AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY row_id) AS n, row_number() OVER (PARTITION BY row_id, role <> 'system' ORDER BY turn) AS k FROM c),
r AS (SELECT row_id, bool_or(i = 1 AND role <> 'system') AS no_leading_system, bool_or(i > 1 AND role = 'system') AS late_system, bool_or(role <> 'system' AND role <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) AS no_alternation, bool_or(i = n AND role <> 'assistant') AS no_assistant_end, bool_or(trim(text) = '') AS empty_content FROM t GROUP BY row_id),
u AS (SELECT 'no_leading_system' AS problem, no_leading_system AS b FROM r UNION ALL SELECT 'late_system', late_system FROM r UNION ALL SELECT 'no_alternation', no_alternation FROM r UNION ALL SELECT 'no_assistant_end', no_assistant_end FROM r UNION ALL SELECT 'empty_content', empty_content FROM r)
SELECT problem, count(*) AS n FROM u WHERE b GROUP BY problem""")
def f9(spark, sf):
    return O.structural_problems(_rows(spark, sf))


@query("f10_drop_parrots", _PLANTED + """, a AS (SELECT row_id, string_agg(text, chr(10) ORDER BY turn) AS answers FROM c WHERE role = 'assistant' GROUP BY row_id)
SELECT c.row_id, bool_or(role = 'user' AND length(text) >= 50 AND contains(coalesce(answers, ''), substr(text, 1, 50))) AS parrot FROM c LEFT JOIN a ON c.row_id = a.row_id GROUP BY c.row_id""")
def f10(spark, sf):
    return O.rows_from_turns(_talk(spark, sf)).select("row_id", O.is_parrot(F.col("messages")).alias("parrot"))


_WORDS = r"len(list_filter(string_split_regex({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))"


@query("f11_length_report", _TEXTS + f""", w AS (SELECT row_id, sum({_WORDS.format('text')}) AS n, coalesce(sum({_WORDS.format('text')}) FILTER (role = 'assistant'), 0) AS a FROM c GROUP BY row_id)
SELECT count(*) AS n_rows, CAST(min(n) AS BIGINT) AS lo, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(n, 0.9) AS DOUBLE) AS p90, CAST(quantile_cont(n, 0.99) AS DOUBLE) AS p99, CAST(max(n) AS BIGINT) AS hi, sum(a)::DOUBLE / sum(n)::DOUBLE AS assistant_share, count(*) FILTER (n > 4096) AS dropped, avg((n > 4096)::INT) >= 0.02 AS failed FROM w""")
def f11(spark, sf):
    return O.length_report(_rows(spark, sf))


@query("g14_repeated_turn", _PLANTED + r", u AS (SELECT row_id, role, substr(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 80) AS t FROM c) SELECT row_id, count(*) FILTER (role = 'user') > count(DISTINCT t) FILTER (role = 'user') AS repeated FROM u GROUP BY row_id")
def g14(spark, sf):
    return O.rows_from_turns(_talk(spark, sf)).select("row_id", O.repeated_turn(F.col("messages")).alias("repeated"))


@query("g16_turn_count", _TEXTS + " SELECT row_id, (count(*) FILTER (role = 'assistant') > 1) = (row_id % 2 = 0) AS agrees FROM c GROUP BY row_id")
def g16(spark, sf):
    return _rows(spark, sf).select("row_id", O.turn_count_agrees(F.col("messages"), F.col("row_id") % 2 == 0).alias("agrees"))


@query("g18_cjk", _PLANTED + f" SELECT row_id, bool_or(role <> 'system' AND regexp_matches(text, '[{CJK}]')) AS cjk FROM c GROUP BY row_id")
def g18(spark, sf):
    return O.rows_from_turns(_talk(spark, sf)).select("row_id", O.has_cjk(F.col("messages")).alias("cjk"))


# ---- H, I, J: planning, dedup, audits ------------------------------------------------------------------------


@query("h1_apportion", """WITH w AS (SELECT o_orderpriority AS name, count(*) AS weight FROM orders GROUP BY 1), x AS (SELECT *, weight * 1000 / sum(weight) OVER ()::DOUBLE AS e FROM w), f AS (SELECT *, floor(e) AS fl, round(e - floor(e), 9) AS rest FROM x)
SELECT name, weight, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, name) <= 1000 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""")
def h1(spark, sf):
    return O.apportion(table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("weight")), 1000)


def _tagged(spark, sf):
    rows = _rows(spark, sf).withColumn("key", F.md5(O.text_key(F.col("messages"))))
    return rows.withColumns({"component": F.concat(F.lit("c"), (F.col("row_id") % 8).cast("string")), "domain": F.concat(F.lit("d"), (F.col("row_id") % 3).cast("string")), "shard": F.concat(F.lit("s"), (F.col("row_id") % 2).cast("string"))})


_TAGGED = _TEXTS + ", t AS (SELECT row_id, md5(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'system'), '')) AS key, 'c' || row_id % 8 AS component, 'd' || row_id % 3 AS domain, 's' || row_id % 2 AS shard FROM c GROUP BY row_id)"


@query("h5_topup_plan", _TAGGED + ", p AS (SELECT name AS component, target FROM (VALUES ('c0', 5), ('c1', 500), ('c9', 10)) v(name, target)), h AS (SELECT component, count(*) AS have FROM t GROUP BY 1) SELECT component, target::INT AS target, coalesce(have, 0) AS have, greatest(target - coalesce(have, 0), 0) AS missing, 6 * greatest(target - coalesce(have, 0), 0) AS attempts FROM p LEFT JOIN h USING (component)")
def h5(spark, sf):
    return O.topup_plan(_tagged(spark, sf), spark.createDataFrame([("c0", 5), ("c1", 500), ("c9", 10)], "component string, target int"))


@query("h6_skip_seen", _TAGGED + ", n AS (SELECT row_id, key, row_number() OVER (PARTITION BY key ORDER BY row_id) AS p FROM t WHERE row_id % 4 > 0 AND key NOT IN (SELECT key FROM t WHERE row_id % 4 = 0)) SELECT row_id, key FROM n WHERE p = 1")
def h6(spark, sf):
    t = _tagged(spark, sf)
    return O.skip_seen(t.where("row_id % 4 > 0"), t.where("row_id % 4 = 0"), "key", "row_id").select("row_id", "key")


@query("h7_shard_tally", _TAGGED + ", g AS (SELECT s.shard, k.component, k.target FROM (SELECT DISTINCT shard FROM t) s CROSS JOIN (SELECT 'c' || range AS component, 20 AS target FROM range(9)) k) SELECT g.shard, g.component, count(t.row_id) AS n, CASE WHEN count(t.row_id) >= any_value(target) THEN 'OK' ELSE 'SHORT' END AS verdict FROM g LEFT JOIN t ON t.shard = g.shard AND t.component = g.component GROUP BY 1, 2")
def h7(spark, sf):
    return O.shard_tally(_tagged(spark, sf), {f"c{i}": 20 for i in range(9)}).drop("target")


@query("i1_exact_dedup", "SELECT doc_id, md5(text) AS key FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS p FROM documents) WHERE p = 1")
def i1(spark, sf):
    return O.exact_dedup(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key")), "key", "doc_id")


_SPLIT = _TAGGED + ", x AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY component ORDER BY md5('42|' || row_id), row_id) <= floor(count(*) OVER (PARTITION BY component) * 0.9) THEN 'train' ELSE 'eval' END AS split FROM t)"


@query("i3_split_rows", _SPLIT + " SELECT row_id, component, split FROM x")
def i3(spark, sf):
    return O.split_rows(_tagged(spark, sf), "component").select("row_id", "component", "split")


@query("j1_composition", _TAGGED + " SELECT 'component' AS kind, component AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'shard', shard, count(*) FROM t GROUP BY 2")
def j1(spark, sf):
    return O.composition(_tagged(spark, sf))


@query("j5_review_sample", _TAGGED + " SELECT row_id, component, place FROM (SELECT row_id, component, row_number() OVER (PARTITION BY component ORDER BY md5('42|' || row_id), row_id) AS place FROM t) WHERE place <= 2")
def j5(spark, sf):
    return O.review_sample(_tagged(spark, sf), "component").select("row_id", "component", "place")


# ---- L: batch forms of the streams ---------------------------------------------------------------------------


@query("l1_progress_board", "SELECT event_type AS component, count(*) AS n, max(ts) AS last_ts, date_diff('second', max(ts), (SELECT max(ts) FROM events)) > 1200 AS stalled FROM events GROUP BY 1")
def l1(spark, sf):
    from ..streaming.progress import progress_board

    return progress_board(table(spark, sf, "events").withColumnRenamed("event_type", "component"))


@query("l6_rate_windows", "SELECT event_type AS component, time_bucket(INTERVAL '10 minutes', ts) AS window_start, count(*) AS accepted FROM events GROUP BY 1, 2")
def l6(spark, sf):
    from ..streaming.progress import rate_windows

    return rate_windows(table(spark, sf, "events").withColumnRenamed("event_type", "component")).select("component", "window_start", "accepted")
