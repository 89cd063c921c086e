"""Registered queries over composed retrieval, page geometry, facts by source and the reports' halves, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import pages as P
from ..operators import planning as H
from ..operators import retrieval as R
from ..operators import rows as O
from . import registered as base
from .catalogue import query, table

# ---- B: characters and pages ---------------------------------------------------------------------------------


@query("b17_vocabulary_characters", "WITH v AS (SELECT DISTINCT unnest(string_split(lower(n_name) || ' ' || coalesce(n_name, ''), '')) AS c FROM nation) SELECT c AS ch, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS c FROM documents) WHERE c <> '' AND c NOT IN (SELECT c FROM v) GROUP BY c")
def b17v(spark, sf):
    vocabulary = table(spark, sf, "nation").select(F.explode(F.split(F.concat(F.lower("n_name"), F.lit(" "), "n_name"), "")).alias("ch"))
    return O.oov_characters(table(spark, sf, "documents"), vocabulary)


# Boxes of pages and of one to three images: scans, logos of the page's shape, strips, images without pixels, no image, no area.
_BOX = {"width_pt": "CASE WHEN page_id % 11 = 10 THEN 0.0 ELSE 595.0 + page_id % 3 END", "height_pt": "842.0 - page_id % 5", "font_count": "CAST(page_id % 4 AS INT)"}
_TEXT = "CASE WHEN page_id % 5 = 0 THEN '  ' WHEN page_id % 5 = 1 THEN concat(' few words ', page_id, ' ') ELSE substr(html, 1, 40 * CAST(page_id % 50 AS INT)) END"
_IMAGES = [("page_id % 3 = 0", "1240 + page_id % 7", "1754"), ("page_id % 4 = 1", "300", "430"), ("page_id % 6 > 3", "2000", "600"), ("page_id % 9 = 2", "0", "10"), ("page_id % 9 = 4", "900 + 10 * (page_id % 20)", "1400")]
_BAD = r"\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x{E000}-\x{F8FF}"


@query("b20_page_geometry", rf"""WITH p AS (SELECT page_id, {", ".join(f"{e} AS {c}" for c, e in _BOX.items())}, regexp_replace({_TEXT}, '^\s+|\s+$', '', 'g') AS t, list_filter([{", ".join(f"CASE WHEN {w} THEN {{'w': ({x})::DOUBLE, 'h': ({y})::DOUBLE}} END" for w, x, y in _IMAGES)}], lambda i: i IS NOT NULL) AS images FROM pages),
a AS (SELECT *, width_pt / 72 AS wi, height_pt / 72 AS hi FROM p), s AS (SELECT *, length(t) / CASE WHEN wi * hi = 0 THEN 1.0 ELSE wi * hi END AS char_density, len(images) AS image_count, coalesce(list_max(list_transform(images, lambda i: i.w * i.h / 1000000)), 0.0) AS mp, (length(t) - length(regexp_replace(t, '[{_BAD}]', '', 'g'))) / greatest(length(t), 1)::DOUBLE AS bad,
list_max(list_transform(list_filter(images, lambda i: i.w > 0 AND i.h > 0 AND wi > 0 AND abs(i.w / i.h - wi / hi) / (wi / hi) <= 0.15 AND i.w / wi >= 72), lambda i: i.w / wi)) AS dpi FROM a)
SELECT page_id, round(char_density, 9) AS char_density, CAST(image_count AS INT) AS image_count, dpi IS NOT NULL AS has_full_page_raster, CAST(round_even(dpi, 0) AS INT) AS full_raster_dpi, round(mp, 9) AS max_image_megapixels,
CASE WHEN font_count = 0 AND image_count = 0 THEN 'empty' WHEN font_count = 0 OR dpi IS NOT NULL AND char_density < 3 THEN 'ocr_required' WHEN dpi IS NOT NULL THEN 'ocr_preferred' WHEN bad > 0.1 OR char_density < 1 AND image_count > 0 THEN 'ocr_required' WHEN char_density < 1 THEN 'empty' WHEN mp >= 1 THEN 'ocr_preferred' ELSE 'native' END AS strategy FROM s""")
def b20g(spark, sf):
    images = F.array_compact(F.array(*[F.when(F.expr(w), F.struct(F.expr(f"CAST({x} AS INT)").alias("px_w"), F.expr(f"CAST({y} AS INT)").alias("px_h"))) for w, x, y in _IMAGES]))
    rows = table(spark, sf, "pages").select("page_id", *[F.expr(e).alias(c) for c, e in _BOX.items()], F.expr(_TEXT).alias("text"), images.alias("images"))
    done = P.classify_pages(P.page_signals(rows))
    return done.select("page_id", F.round("char_density", 9).alias("char_density"), "image_count", "has_full_page_raster", "full_raster_dpi", F.round("max_image_megapixels", 9).alias("max_image_megapixels"), "strategy")


# ---- D: composed retrieval -----------------------------------------------------------------------------------

_ASKS = "SELECT vec_id AS query_id, embedding AS qv, label AS qd, label % 2 AS target FROM embeddings WHERE vec_id % 20 = 0"
_HAS = "SELECT vec_id AS chunk_id, embedding AS cv, label AS cd, label % 3 % 2 AS language, vec_id % 10 = 3 AS upload, 'doc ' || vec_id || ' ' || substr(coalesce(text, ''), 1, 200) AS content, d.source FROM embeddings JOIN documents d ON doc_id = vec_id"


def _retrieved(threshold: str, uploads: str, context: str = "md5(coalesce(context, '')) AS context_md5") -> str:
    return f"""WITH q AS ({_ASKS}), c AS ({_HAS}), s AS (SELECT query_id, qd, target, chunk_id, language, content, source, list_cosine_similarity(qv::DOUBLE[], cv::DOUBLE[]) AS sim FROM q JOIN c ON chunk_id <> query_id AND ({uploads})),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20), a AS (SELECT *, language = target AS same, sum((language = target)::INT) OVER (PARTITION BY query_id) AS n_same FROM r WHERE {threshold}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n_same >= 4 AND NOT same THEN 1 ELSE 0 END, rank) AS place FROM a QUALIFY place <= 4), t AS (SELECT query_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context, bool_or(NOT same) AS crossed FROM k GROUP BY 1),
o AS (SELECT query_id, string_agg(source, '|' ORDER BY first) AS sources FROM (SELECT query_id, source, min(place) AS first FROM k WHERE source <> '' GROUP BY 1, 2) GROUP BY 1)
SELECT q.query_id, {context}, coalesce(sources, '') AS sources, coalesce(crossed, false) AS cross_language, sha256(qd || '|fr|q' || q.query_id) AS fingerprint FROM q LEFT JOIN t USING (query_id) LEFT JOIN o USING (query_id)"""


def _retrieve(spark, sf, backend, threshold):
    e = table(spark, sf, "embeddings")
    asks = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("vector"), F.col("label").alias("domain"), F.lit("fr").alias("ui_lang"), (F.col("label") % 2).alias("target_language"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    upload = F.when(F.col("vec_id") % 10 == 3, F.concat(F.lit("u"), F.col("vec_id").cast("string")))
    content = F.concat(F.lit("doc "), F.col("vec_id").cast("string"), F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, 200))
    has = e.join(texts, "vec_id").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("domain"), upload.alias("source_file_id"), content.alias("content"), "source", (F.col("label") % 3 % 2).alias("language"))
    return R.retrieve(asks, has, backend, threshold=threshold)


def _told(found):
    return found.select("query_id", F.md5("context").alias("context_md5"), F.array_join("sources", "|").alias("sources"), "cross_language", "fingerprint")


@query("d5_retrieve_indexed", _retrieved("sim >= 0.2", "cd = qd OR upload"))
def d5_indexed(spark, sf):
    return _told(_retrieve(spark, sf, "indexed", 0.2))


@query("d5_retrieve_local", _retrieved("true", "cd = qd AND NOT upload"))
def d5_local(spark, sf):
    return _told(_retrieve(spark, sf, "local", None))


# ---- F, H, J: rows and generation ----------------------------------------------------------------------------


@query("f9_control_tokens", "SELECT 'control_token' AS problem, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 4 = 1 HAVING count(*) > 0")
def f9_tokens(spark, sf):
    token = F.when(F.col("conv_id") % 8 == 1, "<eos>").when(F.col("conv_id") % 8 == 5, "a<start_of_turn>b").otherwise("< eos >")
    rows = O.rows_from_turns(table(spark, sf, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), token)))
    return O.structural_problems(rows).where("problem = 'control_token'")


@query("j1_split_composition", base._TAGGED + ", s AS (SELECT component, CASE WHEN row_id % 8 < 3 OR row_id % 16 > 12 THEN 'train' ELSE 'eval' END AS split FROM t) SELECT component, count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'eval') AS eval, count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'eval') = 0 AS missing FROM s GROUP BY component")
def j1_split(spark, sf):
    split = F.when((F.col("row_id") % 8 < 3) | (F.col("row_id") % 16 > 12), "train").otherwise("eval")
    return O.split_composition(base._tagged(spark, sf).withColumn("split", split))


@query("j1_prompt_repetition", "WITH c AS (SELECT conv_id, arg_min(substr(coalesce(text, ''), 1, 1), turn) AS head FROM conversations GROUP BY conv_id) SELECT count(*) AS n_rows, count(DISTINCT head) AS n_prompts, round(count(*) / count(DISTINCT head)::DOUBLE, 6) AS repetition FROM c")
def j1_prompts(spark, sf):
    return O.prompt_repetition(O.rows_from_turns(table(spark, sf, "conversations").withColumn("text", F.substring("text", 1, 1))))


_OUTCOME = "CASE WHEN event_id % 7 = 0 THEN 'parse_failure' WHEN event_id % 11 = 1 THEN 'duplicate' WHEN value < 30 OR event_id % 5 = 2 THEN 'rejected' ELSE 'accepted' END"
_REASON = "CASE WHEN value < 10 THEN 'missing_citation' WHEN value < 20 THEN 'missing_french' ELSE 'repeated_turn' END"
_NAMES = ("missing_citation", "missing_french", "repeated_turn")
_BUDGET = "CASE gate WHEN 'missing_citation' THEN 40 WHEN 'missing_french' THEN 0 ELSE 2000 END"


@query("h4_generation_stats", f"""WITH e AS (SELECT event_type AS component, {_OUTCOME} AS outcome, {_REASON} AS reason, event_id % 13 = 3 AS salvaged, user_id % 3 = 0 AS arabic FROM events),
g AS (SELECT component, count(*) AS attempts, count(*) FILTER (outcome = 'accepted') AS generated, count(*) FILTER (outcome = 'parse_failure') AS parse_failures, count(*) FILTER (salvaged) AS salvaged, count(*) FILTER (outcome = 'duplicate') AS duplicates, {", ".join(f"count(*) FILTER (outcome = 'rejected' AND reason = '{n}') AS n_{n}" for n in _NAMES)}, round(avg(arabic::INT) FILTER (outcome = 'accepted'), 6) AS arabic_share FROM e GROUP BY component)
SELECT *, array_to_string(list_filter([CASE WHEN n_missing_citation >= 40 THEN 'missing_citation' END, CASE WHEN n_repeated_turn >= 2000 THEN 'repeated_turn' END], lambda x: x IS NOT NULL), ',') AS exhausted FROM g""")
def h4_stats(spark, sf):
    e = table(spark, sf, "events")
    attempts = e.select(F.col("event_type").alias("component"), F.expr(_OUTCOME).alias("outcome"), F.expr(_REASON).alias("reject_reason"), (F.col("event_id") % 13 == 3).alias("salvaged"), (F.col("user_id") % 3 == 0).alias("arabic_script"))
    budgets = e.select(F.col("event_type").alias("component")).distinct().withColumn("gate", F.explode(F.array(*map(F.lit, _NAMES)))).withColumn("budget", F.expr(_BUDGET))
    return H.generation_stats(attempts, list(_NAMES), budgets)


# ---- J, K: facts and reports ---------------------------------------------------------------------------------


@query("j6_source_totals", "SELECT source, count(*) AS n_chunks, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM documents GROUP BY source")
def j6_totals(spark, sf):
    return V.source_totals(table(spark, sf, "documents").select("source", F.col("text").alias("content")))


_FACTS = "SELECT DISTINCT doc_id % 50 AS label, substr(text, 1 + CAST(doc_id % 7 AS INT), 9) AS needle, source FROM documents WHERE doc_id % 10 = 0 AND source IS NOT NULL"


@query("j6_facts_by_source", f"WITH n AS ({_FACTS}), h AS (SELECT n.source, n.needle, count(*) AS hits FROM (SELECT DISTINCT source, needle FROM n WHERE needle <> '') n JOIN documents d ON d.source = n.source AND contains(d.text, n.needle) GROUP BY 1, 2) SELECT n.label, n.needle, n.source, coalesce(hits, 0) AS hits, coalesce(hits, 0) > 0 AS stored FROM n LEFT JOIN h ON h.source = n.source AND h.needle = n.needle")
def j6_by_source(spark, sf):
    docs = table(spark, sf, "documents")
    needles = docs.where("doc_id % 10 = 0 AND source IS NOT NULL").select((F.col("doc_id") % 50).alias("label"), F.expr("substr(text, 1 + CAST(doc_id % 7 AS INT), 9)").alias("needle"), "source")
    return V.facts_by_source(docs.select("source", F.col("text").alias("content")), needles)


_NEEDLE = "CASE WHEN vec_id % 3 = 0 THEN '---' WHEN vec_id % 3 = 1 THEN concat('doc ', vec_id) ELSE '' END"


@query("j6_retrieved_facts", f"WITH x AS ({_retrieved('sim >= 0.2', 'cd = qd OR upload', 'context')}), n AS (SELECT vec_id AS label, vec_id + vec_id % 40 AS query_id, {_NEEDLE} AS needle FROM embeddings WHERE vec_id % 20 = 0) SELECT label, n.query_id, needle, coalesce(needle <> '' AND contains(context, needle), false) AS retrieved, CAST(length(coalesce(context, '')) AS INT) AS context_chars FROM n LEFT JOIN x ON x.query_id = n.query_id")
def j6_retrieved(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id % 20 = 0")
    needles = e.select(F.col("vec_id").alias("label"), (F.col("vec_id") + F.col("vec_id") % 40).alias("query_id"), F.expr(_NEEDLE).alias("needle"))
    return V.retrieved_facts(needles, _retrieve(spark, sf, "indexed", 0.2)).drop("sources")


@query("k3_refusal_groups", base._RESOLVED + ", d AS (SELECT gold, gold % 2 = 0 AS odd, domain_source = 'no_match' OR query_id % 40 = 0 AS refused FROM x) SELECT gold AS grp, count(*) AS n, count(*) FILTER (odd) AS ood, CASE WHEN count(*) FILTER (odd) > 0 THEN round(count(*) FILTER (odd AND refused) / count(*) FILTER (odd)::DOUBLE, 6) END AS ood_refusal_rate FROM d GROUP BY gold")
def k3_groups(spark, sf):
    decided = R.refusal(base._resolved(spark, sf).withColumn("context_chars", F.when(F.col("query_id") % 40 == 0, 0).otherwise(10)))
    return V.refusal_by_group(decided.withColumn("expected_refusal", F.col("gold") % 2 == 0), "gold").withColumnRenamed("gold", "grp")


@query("k6_engine_runs", "SELECT user_id AS engine, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_wer, round(avg(value / 2) FILTER (event_type <> 'error'), 6) AS mean_cer, round(avg(value / nullif(event_id % 5, 0)) FILTER (event_type <> 'error'), 6) AS mean_rtf FROM events GROUP BY user_id")
def k6_runs(spark, sf):
    runs = table(spark, sf, "events").select(F.col("user_id").alias("engine"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("wer"), (F.col("value") / 2).alias("cer"), F.col("value").alias("seconds"), (F.col("event_id") % 5).alias("duration"))
    return V.engine_summary(runs)


@query("k9_switch_latency", "WITH b AS (SELECT value::DECIMAL(18, 6) AS v, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) SELECT count(*) FILTER (s) AS alternating_n, sum(v) FILTER (s)::DOUBLE / count(*) FILTER (s) AS alternating_mean, count(*) FILTER (NOT s) AS same_n, sum(v) FILTER (NOT s)::DOUBLE / count(*) FILTER (NOT s) AS same_mean FROM b")
def k9_switch(spark, sf):
    return V.switch_latency(table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_index"), F.col("event_type").alias("language"), F.col("value").alias("seconds")))
