"""Registered queries over pages, prompts, sticky languages and upload votes, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates as G
from ..operators import conversation as C
from ..operators import pages as P
from ..operators import retrieval as R
from . import registered as base
from . import registered_text as text
from .catalogue import ORACLES, query, table

#: Page signals drawn from the html, one expression for both engines: every rung of the ladder is met.
_SIGNALS = {
    "char_density": "CASE WHEN page_id % 4 = 0 THEN 0.5 WHEN page_id % 4 = 1 THEN 2.0 ELSE length(html) / 93.5 END", "font_count": "page_id % 6", "image_count": "page_id % 5 % 2",
    "has_full_page_raster": "page_id % 7 = 0", "bad_char_ratio": "(length(html) % 13) / 100.0", "max_image_megapixels": "(length(html) % 20) / 10.0",
}


@query("b20_page_strategy", "WITH s AS (SELECT page_id, " + ", ".join(f"{e} AS {n}" for n, e in _SIGNALS.items()) + """ FROM pages)
SELECT page_id, CASE WHEN font_count = 0 AND image_count = 0 THEN 'empty' WHEN font_count = 0 OR has_full_page_raster AND char_density < 3 THEN 'ocr_required' WHEN has_full_page_raster THEN 'ocr_preferred'
WHEN bad_char_ratio > 0.1 OR char_density < 1 AND image_count > 0 THEN 'ocr_required' WHEN char_density < 1 THEN 'empty' WHEN max_image_megapixels >= 1 THEN 'ocr_preferred' ELSE 'native' END AS strategy,
CASE WHEN font_count = 0 THEN if(image_count = 0, 'nothing_on_page', 'no_text_layer') WHEN has_full_page_raster THEN if(char_density < 3, 'scan', 'raster_with_text') WHEN bad_char_ratio > 0.1 THEN 'broken_encoding'
WHEN char_density < 1 THEN if(image_count > 0, 'image_without_text', 'negligible_text') WHEN max_image_megapixels >= 1 THEN 'large_image' ELSE 'usable_text' END AS reason FROM s""")
def b20(spark, sf):
    signals = table(spark, sf, "pages").select("page_id", *[F.expr(e).alias(n) for n, e in _SIGNALS.items()])
    return P.classify_pages(signals).select("page_id", "strategy", "reason")


_TEMPLATE = "Tu es un tuteur pour {domain}.\nCONTEXTE :\n{context}\nFin."


@query("b23_system_prompt", "SELECT doc_id, md5('Tu es un tuteur pour ' || coalesce(source, '') || '.' || chr(10) || 'CONTEXTE :' || chr(10) || coalesce(text, '') || chr(10) || 'Fin.') AS system_md5 FROM documents")
def b23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(P.fill_system_prompt(_TEMPLATE, F.col("source"), F.col("text"))).alias("system_md5"))


@query("b23_prompt_parity", "SELECT count(*) AS n_rows, count(*) FILTER (doc_id % 9 <> 4) AS n_match FROM documents")
def b23_parity(spark, sf):
    filled = P.fill_system_prompt(_TEMPLATE, F.col("source"), F.col("text"))
    return P.prompt_parity(table(spark, sf, "documents").select(F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("?"), filled)).otherwise(filled).alias("system")), _TEMPLATE)


@query("c9_ingest_outcome", """WITH f AS (SELECT doc_id AS id, n_chars // 500 AS n_chunks, n_chars % 3 AS n_unprocessed, CASE WHEN doc_id % 11 = 0 THEN text END AS failure FROM documents)
SELECT id, CASE WHEN failure IS NOT NULL OR n_chunks = 0 THEN 'error' WHEN n_unprocessed > 0 THEN 'partial' ELSE 'ready' END AS status, coalesce(md5(substr(failure, 1, 500)), CASE WHEN n_chunks = 0 THEN md5('no chunks') END) AS error_md5 FROM f""")
def c9(spark, sf):
    files = table(spark, sf, "documents").selectExpr("doc_id AS id", "n_chars DIV 500 AS n_chunks", "n_chars % 3 AS n_unprocessed", "CASE WHEN doc_id % 11 = 0 THEN text END AS failure")
    return P.ingest_outcome(files).select("id", "status", F.md5("error_message").alias("error_md5"))


_UPLOADS = base._SIMS.format(extra="") + """, w AS (SELECT query_id, domain, sum(similarity) AS votes, min(rank) AS best FROM r WHERE rank <= 10 AND similarity >= 0.3 GROUP BY 1, 2),
t AS (SELECT query_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, best) AS p FROM w) WHERE p = 1)
SELECT vec_id AS query_id, coalesce(t.domain, -1) AS domain, if(t.domain IS NULL, 'no_match', 'retrieval') AS domain_source FROM embeddings LEFT JOIN t ON query_id = vec_id WHERE vec_id % 20 = 0"""


@query("c10_upload_domain", _UPLOADS)
def c10(spark, sf):
    probes = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.vote_upload_domain(probes, base._chunks(spark, sf), -1, threshold=0.3).select("query_id", "domain", "domain_source")


_EXPLICIT = "CASE WHEN {id} % 7 = 3 AND {turn} % 6 = 1 THEN 'fr' END"


@query("e4_sticky_language", f"""WITH RECURSIVE b AS ({ORACLES["b4_query_language"]}), i AS ({ORACLES["b5_language_instruction"]}),
m AS (SELECT row_id, turn, lang, asked, {_EXPLICIT.format(id="row_id", turn="turn")} AS explicit, row_number() OVER (PARTITION BY row_id ORDER BY turn) AS p FROM b JOIN i USING (row_id, turn)),
s AS (SELECT row_id, p, turn, coalesce(explicit, lang) AS query_lang, coalesce(explicit, asked, lang) AS response_lang, CASE WHEN explicit IS NOT NULL THEN 'explicit_field' WHEN asked IS NOT NULL THEN 'explicit_instruction' ELSE 'script' END AS response_lang_source,
CASE WHEN explicit IS NULL THEN asked END AS held, lang AS held_lang FROM m WHERE p = 1
UNION ALL SELECT m.row_id, m.p, m.turn, coalesce(explicit, lang), CASE WHEN explicit IS NOT NULL THEN explicit WHEN asked IS NOT NULL THEN asked WHEN held_lang = lang THEN coalesce(held, lang) ELSE lang END,
CASE WHEN explicit IS NOT NULL THEN 'explicit_field' WHEN asked IS NOT NULL THEN 'explicit_instruction' WHEN held IS NOT NULL AND held_lang = lang THEN 'sticky' ELSE 'script' END,
CASE WHEN explicit IS NOT NULL THEN NULL WHEN asked IS NOT NULL THEN asked WHEN held_lang = lang THEN held END, lang FROM s JOIN m ON m.row_id = s.row_id AND m.p = s.p + 1)
SELECT row_id, turn, query_lang, response_lang, response_lang_source FROM s""")
def e4(spark, sf):
    turns = text._turns(spark, sf).withColumn("explicit_language", F.expr(_EXPLICIT.format(id="session_id", turn="turn_index")))
    return C.resolve_languages(turns).withColumnsRenamed({"session_id": "row_id", "turn_index": "turn"})


_GLOSS = "CASE WHEN role = 'assistant' AND conv_id % 4 = 1 THEN concat(text, ' السلامة المهنية (la sécurité)') WHEN role = 'user' OR conv_id % 4 = 2 THEN concat(text, ' السلامة (12)') ELSE text END"


@query("g9_translated_then_bracketed", f"SELECT conv_id AS row_id, bool_or(role = 'assistant' AND regexp_matches(coalesce({_GLOSS}, ''), '[؀-ۿ]{{3,}}[؀-ۿ\\s]*\\(\\s*(?:les?|la|du|de)?\\s*[A-Za-z][^)]{{2,}}\\)')) AS passes FROM conversations GROUP BY 1")
def g9(spark, sf):
    rows = text.O.rows_from_turns(table(spark, sf, "conversations").withColumn("text", F.expr(_GLOSS)))
    return rows.select("row_id", G.translates_then_brackets(F.col("messages")).alias("passes"))
