"""Registered queries over generation: normalised rows and the work-list, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalise as N
from ..operators import work_list as W
from .catalogue import query, table

# Texts without Arabic letters, a planted mention, and in every branch of what a question is: marked, asked, the last line.
_LINE = "chr(10)"
_SAID = f"regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' '{{g}})"
_TURN = f"""CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN NULL WHEN conv_id % 4 = 0 AND turn = 0 THEN concat('Question: ', {_SAID}, ' Answer: oui') WHEN conv_id % 4 = 1 AND turn = 0 THEN concat('Voici. ', {_SAID}, '? Bien. ', {_LINE}, 'Fin')
WHEN conv_id % 4 = 2 AND turn = 0 THEN concat('Un ', {_SAID}, {_LINE}, {_LINE}, '  la fin ', {_LINE}) WHEN turn % 2 = 1 THEN concat('selon l-madda 3, ', {_SAID}, ' puis madda 3 et madda 40') ELSE concat({_SAID}, ' end') END"""
_ROLE = "CASE WHEN conv_id % 5 < 2 AND role = 'user' THEN 'assistant' WHEN conv_id % 6 = 5 AND turn = 2 THEN NULL ELSE role END"
_SYSTEM = "CASE WHEN conv_id % 3 = 0 THEN 'Tutor.' ELSE concat('Tutor. CONTEXTE :', chr(10), 'المادة 3 dit ', CAST(conv_id AS VARCHAR(20))) END"
_LANGUAGE = "CASE WHEN conv_id % 8 = 3 THEN 'fr' ELSE 'darija' END"

_CAPITAL = "CASE WHEN regexp_matches(x[1], '[a-z]') THEN upper(x[1]) || x[2:] ELSE x END"


def _trimmed(name: str, content: str) -> str:
    """From the first user turn to the last answer after it, neighbours of one role joined."""
    return f"""{name}0 AS (SELECT *, {content} AS said, min(p) FILTER (role = 'user') OVER (PARTITION BY row_id) AS lo, max(p) FILTER (role = 'assistant') OVER (PARTITION BY row_id) AS hi FROM kept),
{name}1 AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY row_id ORDER BY p) <> role, true)::INT AS new FROM {name}0 WHERE p BETWEEN lo AND hi), {name}2 AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY p) AS run FROM {name}1),
{name}3 AS (SELECT row_id, run, any_value(role) AS role, string_agg(said, chr(10) ORDER BY p) AS said FROM {name}2 GROUP BY row_id, run), {name} AS (SELECT row_id, string_agg(role || ':' || said, '|' ORDER BY run) AS m FROM {name}3 GROUP BY row_id)"""


_CITED = "role = 'assistant' AND cites"
_PRIMARY = f"CASE WHEN {_CITED} AND language <> 'fr' THEN replace(replace(text, 'l-madda 3,', 'المادة 3,'), ' madda 3 ', ' المادة 3 ') ELSE text END"
_SECOND = f"(SELECT {_CAPITAL} FROM (SELECT CASE WHEN {_CITED} THEN replace(replace(text, 'l-madda 3,', 'المادة 3 (l-madda 3),'), ' madda 3 ', ' l-madda 3 ') ELSE text END AS x))"
_F4 = f"""WITH c AS (SELECT conv_id AS row_id, turn, {_ROLE} AS role, {_TURN.format(g=", 'g'")} AS text, {_SYSTEM} AS system, conv_id % 3 > 0 AS cites, {_LANGUAGE} AS language FROM conversations),
r AS (SELECT row_id, any_value(system) AS system, any_value(cites) AS cites, any_value(language) AS language, coalesce(bool_or(role = 'user'), false) AS has_user, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS said FROM c GROUP BY row_id),
q AS (SELECT *, regexp_replace(regexp_extract(said, '(?is)(?:Question|So2al|Soal|Q)\\s*[:\\-]\\s*(.*?)(?:Réponse|Answer|A\\s*[:\\-]|\\z)', 1), '^\\s+|\\s+$', '', 'g') AS marked,
list_filter(string_split(regexp_replace(said, '([.!\\n])', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(s, '?')) AS asked, list_filter(list_transform(string_split(said, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS lines FROM r),
u AS (SELECT row_id, 'user' AS role, CASE WHEN marked <> '' THEN marked WHEN len(asked) > 0 THEN array_to_string(list_transform(asked, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), ' ') ELSE coalesce(lines[-1], '') END AS text FROM q WHERE NOT has_user),
kept AS (SELECT x.*, cites, language FROM (SELECT row_id, -1 AS p, role, text FROM u WHERE text <> '' UNION ALL SELECT row_id, turn, coalesce(role, 'user'), text FROM c WHERE text IS NOT NULL AND coalesce(role, 'user') <> 'system') x JOIN r USING (row_id)),
{_trimmed("a", _PRIMARY)}, {_trimmed("b", _SECOND)}
SELECT r.row_id, md5('system:' || system || coalesce('|' || a.m, '')) AS messages_md5, md5('system:' || system || coalesce('|' || b.m, '')) AS arabizi_md5, 'c' || r.row_id % 3 AS component, 'd' || r.row_id % 4 AS domain, false AS arabic_script FROM r LEFT JOIN a USING (row_id) LEFT JOIN b USING (row_id)"""


def _flat(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


@query("f4_normalised_rows", _F4)
def f4(spark, sf):
    turns = table(spark, sf, "conversations").withColumns({"role": F.expr(_ROLE), "text": F.expr(_TURN.format(g=""))})
    given = table(spark, sf, "conversations").select("conv_id", F.expr(_SYSTEM).alias("system"), F.expr(_LANGUAGE).alias("language")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))  # null contents stay
    rows = turns.groupBy(F.col("conv_id").alias("row_id")).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")).join(given.withColumnRenamed("conv_id", "row_id"), "row_id")
    done = N.normalise_rows(rows, F.col("system"), F.concat(F.lit("c"), (F.col("row_id") % 3).cast("string")), F.concat(F.lit("d"), (F.col("row_id") % 4).cast("string")), F.col("language"))
    return done.select("row_id", F.md5(_flat("messages")).alias("messages_md5"), F.md5(_flat("messages_arabizi")).alias("arabizi_md5"), "component", "domain", "arabic_script")


# sources are domains, two of them in the generalization scope; every third document of some is in Arabic letters
_CONTENT = "CASE WHEN doc_id % 3 = 0 AND lang <> 'fr' THEN concat(' السلامة المهنية والصحة في أماكن العمل ', CAST(doc_id AS VARCHAR(20)), ' ') ELSE text END"
_TARGETS = [("socratic", 120, "darija", 0.6), ("grounded_refusal", 90, "darija", 0.4), ("quiz_generation", 60, "darija", 0.0), ("no_context_refusal", 30, "darija", 0.1), ("darija_preservation", 40, "darija", 0.0), ("structured_explanation", 80, "fr", 0.5), ("learner_adaptation", 50, "fr", 0.3), ("none", 0, "fr", 0.5)]
_U = "('0x' || substr(md5(concat_ws('|', '42', component, attempt, '{}')), 1, 8))::BIGINT / 4294967296.0"
_H2 = f"""WITH corpus AS (SELECT doc_id::VARCHAR AS path, coalesce(source, 'unknown') AS domain, CASE WHEN source IN (SELECT source FROM documents GROUP BY source ORDER BY md5(source) LIMIT 2) THEN 'generalization' ELSE 'client' END AS scope, coalesce({_CONTENT}, '') AS content FROM documents),
targets AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {n}, '{lang}', {pct}::DOUBLE)" for c, n, lang, pct in _TARGETS)}) t(component, attempts, language, pct)),
jobs AS (SELECT *, {_U.format("turns")} < pct AS multi_turn, {_U.format("kind")} AS u_kind, {_U.format("domain")} AS u_domain, {_U.format("script")} AS u_script, {_U.format("document")} AS u_document FROM (SELECT *, unnest(range(attempts)) AS attempt FROM targets)),
known AS (SELECT *, row_number() OVER (PARTITION BY general ORDER BY domain) - 1 AS place, count(*) OVER (PARTITION BY general) AS size FROM (SELECT domain, bool_and(scope = 'generalization') AS general FROM corpus WHERE domain <> 'unknown' GROUP BY domain)),
n AS (SELECT coalesce(max(size) FILTER (general), 0) AS g, coalesce(max(size) FILTER (NOT general), 0) AS c FROM known),
about AS (SELECT j.*, domain FROM (SELECT *, CASE WHEN g = 0 OR c = 0 THEN c = 0 ELSE u_kind < 0.2 END AS general FROM jobs, n) j JOIN known k ON k.general = j.general AND k.place = floor(u_domain * CASE WHEN j.general THEN g ELSE c END)),
docs AS (SELECT *, length(regexp_replace(content, '[^ء-ي]', '', 'g')) > length(regexp_replace(content, '[^A-Za-z]', '', 'g')) * 0.15 AS arabic FROM corpus), pools AS (SELECT *, row_number() OVER (PARTITION BY domain, arabic ORDER BY md5(path), path) - 1 AS place FROM docs),
sizes AS (SELECT domain, count(*) FILTER (arabic) AS n_arabic, count(*) FILTER (NOT arabic) AS n_latin FROM docs GROUP BY domain),
want AS (SELECT a.*, coalesce(n_arabic, 0) AS na, coalesce(n_latin, 0) AS nl, CASE WHEN language = 'fr' AND component IN ('socratic', 'structured_explanation') AND n_arabic > 0 AND n_latin > 0 THEN u_script < 0.2 WHEN language = 'fr' THEN false WHEN component = 'grounded_refusal' AND n_arabic > 0 AND n_latin > 0 THEN u_script < 0.5 ELSE component IN ('grounded_refusal', 'quiz_generation') END AS first FROM about a LEFT JOIN sizes s ON s.domain = a.domain),
pick AS (SELECT *, CASE WHEN first THEN na > 0 ELSE nl = 0 END AS arabic, component IN ('socratic', 'code_switching', 'grounded_refusal', 'quiz_generation', 'injection_resistance', 'structured_explanation', 'learner_adaptation') AS grounded FROM want)
SELECT component, p.attempt::BIGINT AS attempt, language, p.domain, multi_turn, path, md5(CASE WHEN grounded THEN regexp_replace(coalesce(left(content, 1200), 'No context available.'), '^\\s+|\\s+$', '', 'g') WHEN component = 'no_context_refusal' THEN '' ELSE 'General enterprise knowledge.' END) AS context_md5
FROM pick p LEFT JOIN pools d ON grounded AND d.domain = p.domain AND d.arabic = p.arabic AND d.place = floor(u_document * CASE WHEN p.arabic THEN na ELSE nl END)"""


@query("h2_work_list", _H2)
def h2(spark, sf):
    docs = table(spark, sf, "documents")
    general = docs.where("source IS NOT NULL").select("source").distinct().orderBy(F.md5("source")).limit(2).withColumn("scope", F.lit(W.GENERALIZATION))  # two rows
    corpus = docs.join(F.broadcast(general), "source", "left").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("source", F.lit("unknown")).alias("domain"), F.coalesce("scope", F.lit("client")).alias("scope"), F.expr(_CONTENT).alias("content"))
    targets = spark.createDataFrame(_TARGETS, "component string, attempts long, language string, multi_turn_pct double")
    return W.plan_generation(targets, corpus, 42).select("component", "attempt", "language", "domain", "multi_turn", "path", F.md5("context").alias("context_md5"))
