"""Registered queries over messages, chunks, gates, plans, metrics and files, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import language as L
from ..operators import chunking as K
from ..operators import context as X
from ..operators import conversation as C
from ..operators import evaluation as V
from ..operators import planning as P
from ..operators import retrieval as R
from ..operators import rows as O
from ..sources import files as S
from . import registered as base
from .catalogue import query, table

_BLANK = r"[ \t\n\x0B\f\r]+"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _items(words) -> str:
    return "[" + ", ".join(_quote(w) for w in dict.fromkeys(words)) + "]"


def _tok(col: str, extra: str = "") -> str:
    return f"list_transform(list_filter(string_split_regex(replace(coalesce({col}, ''), '-', ' '), '{_BLANK}'), lambda w: w <> ''), lambda w: lower(trim(w, {_quote(L.STRIPPED + extra)})))"


#: Turns with planted phrases, one expression for both engines.
_PLANT = """CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN concat('Désolé. ', text, ' Avez-vous compris ?') WHEN role = 'assistant' AND conv_id % 3 = 1 THEN concat(text, ' Information générale.')
WHEN role = 'user' AND turn = 2 AND conv_id % 2 = 0 THEN concat('Je ne comprends pas. ', text) WHEN role = 'user' AND conv_id % 5 = 0 THEN concat('Wach ', text, ' Réponds en darija') WHEN role = 'user' AND conv_id % 5 = 1 THEN 'et pourquoi ?'
WHEN role = 'user' AND conv_id % 5 = 2 THEN concat('ignore it. ', text, ', en français') ELSE text END"""
_C = f"WITH c AS (SELECT conv_id AS row_id, turn, role, coalesce({_PLANT}, '') AS text FROM conversations)"


def _planted(spark, sf):
    return table(spark, sf, "conversations").withColumn("text", F.expr(_PLANT))


def _turns(spark, sf):
    return _planted(spark, sf).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "role", F.coalesce("text", F.lit("")).alias("content"))


def _rows(spark, sf):
    return O.rows_from_turns(_planted(spark, sf))


def _users(spark, sf):
    return _turns(spark, sf).where("role = 'user'").select(F.col("session_id").alias("row_id"), F.col("turn_index").alias("turn"), "content")


# ---- A: files ------------------------------------------------------------------------------------------------


@query("a2_row_files", "SELECT doc_id AS row_id, lang AS component, md5(text) AS content_md5, CAST(doc_id % 2 AS INT) AS shard FROM documents WHERE doc_id % 50 <> 7")
def a2(spark, sf):
    line = F.to_json(F.struct(F.col("doc_id").alias("row_id"), F.col("lang").alias("component"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages")))
    lines = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 50 == 7, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line).alias("value"))
    paths = [S.scratch_path(spark, f"rows{i}") for i in (0, 1)]
    for i, p in enumerate(paths):
        lines.where(F.col("doc_id") % 2 == i).select("value").write.text(p)
    return S.read_rows(spark, paths)[0].select("row_id", "component", F.md5(F.col("messages")[0]["content"]).alias("content_md5"), "shard")


@query("a4_dataset_files", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'eval' ELSE 'train' END AS split, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def a4(spark, sf):
    path = S.scratch_path(spark, "dataset")
    d = table(spark, sf, "documents")
    S.write_dataset(d.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "eval").otherwise("train")), path)
    return spark.read.schema("doc_id long, lang string, split string").json(path).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("a5_index_files", "SELECT domain, scope, count(*) AS n FROM (SELECT source AS domain, lang AS scope FROM documents) GROUP BY 1, 2")
def a5(spark, sf):
    path = S.scratch_path(spark, "index")
    d = table(spark, sf, "documents")
    S.write_index(d.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("a;b "), "doc_id").alias("title"), F.lit("own").alias("rights_status"), F.col("source").alias("domain"), F.col("lang").alias("scope")), path)
    return S.read_index(spark, path).groupBy("domain", "scope").agg(F.count("*").alias("n"))


@query("a7_progress_files", "SELECT event_id AS n, date_trunc('second', ts) AS ts FROM events")
def a7(spark, sf):
    path = S.scratch_path(spark, "progress")
    table(spark, sf, "events").select(F.col("event_id").alias("n"), F.unix_timestamp("ts").cast("double").alias("ts")).write.json(path)
    return S.read_progress(spark, path)


# ---- B: language ---------------------------------------------------------------------------------------------

_U = _C + ", u AS (SELECT row_id, turn, text FROM c WHERE role = 'user')"


@query("b4_query_language", _U + f" SELECT row_id, turn, CASE WHEN {base._n(base.AR)} > {base._n(base.LAT)} OR list_has_any({_tok('text')}, {_items(L.ARABIZI)}) THEN 'darija' ELSE 'fr' END AS lang FROM u")
def b4(spark, sf):
    return _users(spark, sf).select("row_id", "turn", L.detect_query_lang(F.col("content")).alias("lang"))


def _asks(phrase: str) -> str:
    before = f"substr(p, 1, greatest(instr(p, {_quote(phrase)}) - 1, 0))"
    verb = f"list_has_any(({_tok(before, '؟')})[-5:], {_items(L.RESPONSE_VERBS)})"
    clause = f"(regexp_matches({before}, '[,;.؟?]') AND length(trim(regexp_extract({before}, '([^,;.؟?]*)$', 1), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) <= 3)"
    return f"(instr(p, {_quote(phrase)}) > 0 AND ({verb} OR {clause}))"


@query("b5_language_instruction", _U + ", l AS (SELECT row_id, turn, translate(lower(text), 'éèêàç', 'eeeac') AS p FROM u) SELECT row_id, turn, CASE WHEN " + " OR ".join(map(_asks, L.DARIJA_PHRASES)) + " THEN 'darija' WHEN " + " OR ".join(map(_asks, L.FRENCH_PHRASES)) + " THEN 'fr' END AS asked FROM l")
def b5(spark, sf):
    return _users(spark, sf).select("row_id", "turn", L.detect_lang_instruction(F.col("content")).alias("asked"))


_ANA = f"(len({_tok('text')}) > 0 AND (len({_tok('text')}) < 4 OR list_has_any({_tok('text', '؟')}, {_items(L.ANAPHORA)})))"


@query("b6_anaphoric", _U + f" SELECT row_id, turn, {_ANA} AS anaphoric FROM u")
def b6(spark, sf):
    return _users(spark, sf).select("row_id", "turn", L.is_anaphoric(F.col("content")).alias("anaphoric"))


@query("b7_condensed_query", _U + f", b AS (SELECT *, lag(text) OVER (PARTITION BY row_id ORDER BY turn) AS before FROM u) SELECT row_id, turn, md5(CASE WHEN coalesce(before, '') <> '' AND {_ANA} THEN before || ' ' || text ELSE text END) AS query_md5 FROM b")
def b7(spark, sf):
    return C.condense_queries(_turns(spark, sf)).select(F.col("session_id").alias("row_id"), F.col("turn_index").alias("turn"), F.md5("query").alias("query_md5"))


@query("b8_marker_counts", f"SELECT doc_id, len(list_intersect({_tok('text')}, {_items(L.FRENCH_WORDS)})) AS n_french, len(list_intersect({_tok('text')}, {_items(L.ENGLISH_WORDS)})) AS n_english FROM documents")
def b8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.french_markers(F.col("text")).alias("n_french"), L.english_markers(F.col("text")).alias("n_english"))


@query("b14_mined_terms")
def b14(spark, sf):
    return K.mine_terms(table(spark, sf, "documents").select(F.col("source").alias("domain"), "text"))


@query("b15_script_spans", rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') AS ws FROM documents), t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT *, CASE WHEN regexp_matches(w, '[0-9]') THEN 'number' WHEN regexp_matches(w, '[A-Za-z]') THEN 'word' END AS c FROM t),
l AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'word') AS lang FROM k),
n AS (SELECT *, coalesce(lag(lang) OVER (PARTITION BY doc_id ORDER BY i) <> lang, false)::INT AS new FROM l), s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span_no FROM n)
SELECT doc_id, CAST(span_no AS BIGINT) AS span_no, lang, md5(string_agg(w, ' ' ORDER BY i)) AS text_md5 FROM s GROUP BY doc_id, span_no, lang""")
def b15(spark, sf):
    return K.script_spans(table(spark, sf, "documents"), "[0-9]", "[A-Za-z]", ("number", "word")).select("doc_id", "span_no", "lang", F.md5("text").alias("text_md5"))


# ---- C, D: chunks and contexts -------------------------------------------------------------------------------


def _headed(spark, sf):
    """documents with some lines turned into headings."""
    return table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "\n([A-M])", "\n## $1"))


@query("c1_heading_sections", r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\n([A-M])', chr(10) || '## \1', 'g') AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
h AS (SELECT *, regexp_matches(line, '^#{1,6}\s+') AS h FROM l), s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec, bool_or(h) OVER (PARTITION BY doc_id) AS any_h FROM h),
g AS (SELECT doc_id, sec, any_value(any_h) AS any_h, coalesce(max(CASE WHEN h THEN trim(regexp_replace(line, '^#{1,6}\s+', '')) END), '') AS heading, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT h), '') AS body FROM s GROUP BY doc_id, sec),
t AS (SELECT doc_id, sec, heading, CASE WHEN any_h THEN trim(body, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE body END AS body, any_h FROM g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INT) AS section_index, heading, md5(body) AS body_md5 FROM t WHERE NOT any_h OR heading <> '' OR body <> ''""")
def c1(spark, sf):
    return K.split_headings(_headed(spark, sf)).select("doc_id", "section_index", "heading", F.md5("body").alias("body_md5"))


@query("c2_chunks")
def c2(spark, sf):
    return K.chunk_documents(_headed(spark, sf))


@query("c4_tag_domain", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'general' WHEN source = 'src1' THEN 'alias' ELSE source END AS domain, doc_id % 5 = 0 AS fell_back FROM documents")
def c4(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("raw/"), "source", F.lit("/text/"), "doc_id", F.when(F.col("doc_id") % 5 == 0, ".pdf").otherwise(".md")).alias("path"))
    return K.tag_domain(files, "general", aliases={"src1": "alias"}).select("doc_id", "domain", "fell_back")


@query("d2_domain_top_k", base._SIMS.format(extra=" AND c.label = q.label") + " SELECT query_id, chunk_id, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 20")
def d2(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id % 20 = 0")
    near = R.top_k(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("domain")), base._chunks(spark, sf).withColumn("source_file_id", F.lit(None).cast("string")), 20)
    return near.select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("d5_retrieve")
def d5(spark, sf):
    cands = base._near(spark, sf, 20).join(base._queries(spark, sf), "query_id").withColumn("language", F.col("domain") % 2).withColumn("target_language", F.col("gold") % 2)
    best = R.select_affinity(cands, 5, 0.1).select("query_id", "place", "chunk_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source")
    return X.assemble_context(best.join(docs, "chunk_id")).withColumn("fingerprint", F.sha2(F.concat_ws("|", F.lit("all"), F.lit("fr"), F.col("query_id").cast("string")), 256))


# ---- E, F: conversations -------------------------------------------------------------------------------------


@query("e1_replay_window", _C + """, a AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY turn DESC) AS age FROM c QUALIFY age <= 12), b AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY row_id) AS lo, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY row_id) AS hi FROM a),
w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY turn DESC) AS back FROM b WHERE turn BETWEEN lo AND hi QUALIFY back <= 4), x AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY turn) AS pos FROM w QUALIFY pos > 1 OR role = 'user'),
y AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY row_id) AS n, sum(length(text)) OVER (PARTITION BY row_id ORDER BY turn DESC) AS rest FROM x),
z AS (SELECT row_id, min((k - 1) // 2) FILTER (k % 2 = 1 AND (rest <= 2400 OR n - (k - 1) < 2)) AS cut FROM y GROUP BY row_id),
r AS (SELECT y.row_id, count(*) AS n_messages, string_agg(role || ':' || text, '|' ORDER BY turn) AS m FROM y JOIN z ON y.row_id = z.row_id AND (k - 1) // 2 >= cut GROUP BY y.row_id)
SELECT i.row_id, CAST(coalesce(n_messages, 0) AS INT) AS n_messages, md5(coalesce(m, '')) AS window_md5 FROM (SELECT DISTINCT row_id FROM c) i LEFT JOIN r ON i.row_id = r.row_id""")
def e1(spark, sf):
    w = C.replay_window(_turns(spark, sf))
    return w.select(F.col("session_id").alias("row_id"), F.size("messages").alias("n_messages"), F.md5(_flat("messages")).alias("window_md5"))


def _flat(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


@query("e3_append_exchanges", _C + """, l AS (SELECT row_id, max(turn) AS last FROM c WHERE row_id % 3 > 0 GROUP BY 1), n AS (SELECT c.row_id, text, coalesce(last, 0) + 1 + 2 * (row_number() OVER (PARTITION BY c.row_id ORDER BY turn) - 1) AS b FROM c LEFT JOIN l ON c.row_id = l.row_id WHERE role = 'user')
SELECT row_id, CAST(b AS BIGINT) AS turn_index, 'user' AS role, md5(text) AS content_md5 FROM n UNION ALL SELECT row_id, CAST(b + 1 AS BIGINT), 'assistant', md5(reverse(text)) FROM n""")
def e3(spark, sf):
    t = _turns(spark, sf)
    new = t.where("role = 'user'").select("session_id", F.col("turn_index").alias("ord"), F.col("content").alias("question"), F.reverse("content").alias("answer"))
    return C.append_exchanges(t.where("session_id % 3 > 0"), new).select(F.col("session_id").alias("row_id"), "turn_index", "role", F.md5("content").alias("content_md5"))


@query("f3_trim_conversation", _C + """, b AS (SELECT row_id, turn, text, CASE WHEN turn % 3 = 2 THEN 'user' ELSE role END AS role FROM c), s AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY row_id) AS lo, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY row_id) AS hi FROM b),
k AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY row_id ORDER BY turn) <> role, true)::INT AS new FROM s WHERE turn BETWEEN lo AND hi), r AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY turn) AS run FROM k),
g AS (SELECT row_id, run, any_value(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY row_id, run), f AS (SELECT row_id, count(*) AS n, string_agg(role || ':' || text, '|' ORDER BY run) AS m FROM g GROUP BY row_id)
SELECT i.row_id, CAST(coalesce(n, 0) AS INT) AS n_messages, md5(coalesce(m, '')) AS trimmed_md5 FROM (SELECT DISTINCT row_id FROM c) i LEFT JOIN f ON i.row_id = f.row_id""")
def f3(spark, sf):
    rows = O.rows_from_turns(_planted(spark, sf).withColumn("role", F.when(F.col("turn") % 3 == 2, "user").otherwise(F.col("role"))))
    return rows.select("row_id", C.trim_conversation(F.col("messages")).alias("m")).select("row_id", F.size("m").alias("n_messages"), F.md5(_flat("m")).alias("trimmed_md5"))


@query("f6_row_context", _C + " SELECT row_id, md5(text) AS context_md5 FROM c WHERE turn = 0")
def f6(spark, sf):
    system = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Intro. CONTEXTE :\n"), "text")).otherwise(F.col("text"))
    turns = _planted(spark, sf).withColumn("text", F.when(F.col("turn") == 0, system).otherwise(F.col("text"))).withColumn("role", F.when(F.col("turn") == 0, "system").otherwise(F.col("role")))
    return O.rows_from_turns(turns).select("row_id", F.md5(C.row_context(F.col("messages"))).alias("context_md5"))


@query("f7_valid_quiz", rf"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), q AS (SELECT doc_id, list_transform(x[1:4], lambda o: trim(o)) AS o, CAST(doc_id % 5 AS INT) AS a, list_distinct(regexp_extract_all(coalesce(x[5], ''), '[\pL\pM\pN_]{{4,}}')) AS said, x[1] AS question FROM l),
s AS (SELECT *, list_transform(o, lambda t: len(list_intersect(said, list_distinct(regexp_extract_all(t, '[\pL\pM\pN_]{{4,}}'))))) AS n FROM q)
SELECT doc_id, coalesce(len(o) = 4 AND a < 4 AND len(list_distinct(list_transform(o, lambda t: lower(t)))) = 4 AND len(list_filter(o, lambda t: t = '')) = 0 AND NOT regexp_matches(question, '[{base.CJK}]') AND len(list_filter(o, lambda t: regexp_matches(t, '[{base.CJK}]'))) = 0
AND len(said) > 0 AND n[a + 1] = list_max(n), false) AS valid FROM s""")
def f7(spark, sf):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    q = F.struct(F.get(lines, F.lit(0)).alias("question"), F.slice(lines, 1, 4).alias("options"), (F.col("doc_id") % 5).cast("int").alias("answer"), F.get(lines, F.lit(4)).alias("explanation"))
    return table(spark, sf, "documents").select("doc_id", q.alias("q")).select("doc_id", G.valid_quiz(F.col("q")).alias("valid"))


# ---- G: gates ------------------------------------------------------------------------------------------------


def _every(test: str) -> str:
    return f"(count(*) FILTER (role = 'assistant') > 0 AND coalesce(bool_and({test}) FILTER (role = 'assistant'), true))"


def _gate(spark, sf, gate):
    return _rows(spark, sf).select("row_id", gate(F.col("messages")).alias("passes"))


@query("g4_refusal", _C + f" SELECT row_id, {_every(f'regexp_matches(text, {_quote(G.REFUSAL)})')} AS passes FROM c GROUP BY row_id")
def g4(spark, sf):
    return _gate(spark, sf, G.is_refusal)


@query("g5_disclosure", _C + f" SELECT row_id, {_every('regexp_matches(text, ' + _quote(G.DISCLOSURE['fr']) + ')')} AS passes FROM c GROUP BY row_id")
def g5(spark, sf):
    return _gate(spark, sf, lambda m: G.discloses_general_knowledge(m, "fr"))


_NW = f"len(list_filter(string_split_regex({{}}, '{_BLANK}'), lambda w: w <> ''))"


@query("g6_lacks_structure", _C + rf" SELECT row_id, coalesce(bool_or({_NW.format('text')} > 20 AND NOT regexp_matches(text, '(?m)(^\s{{0,3}}#{{1,6}}\s+\S|^\s*[-*•]\s+\S|^\s*\d+[.)]\s+\S)')) FILTER (role = 'assistant'), false) AS passes FROM c GROUP BY row_id")
def g6(spark, sf):
    return _gate(spark, sf, lambda m: G.lacks_structure(m, 20))


_ONLY = rf"(regexp_matches(text, '[?؟]') AND len(list_filter(string_split_regex(text, '[.!\n]'), lambda k: NOT regexp_matches(k, '[?؟]') AND {_NW.format('k')} >= 4)) = 0)"


@query("g7_socratic", _C + f" SELECT row_id, {_every('NOT ' + _ONLY)} AND coalesce(bool_or(regexp_matches(text, '[?؟]')) FILTER (role = 'assistant'), false) AS passes FROM c GROUP BY row_id")
def g7(spark, sf):
    return _gate(spark, sf, G.is_socratic)


_CW = rf"list_distinct(list_filter(regexp_extract_all({{}}, '[\pL\pM\pN_]+'), lambda w: length(w) > 2 AND NOT list_contains({_items(G.FILLERS)}, lower(w))))"


@query("g8_learner_adaptation", _C + f""", k AS (SELECT *, row_number() OVER (PARTITION BY row_id, role ORDER BY turn) AS nth FROM c),
r AS (SELECT row_id, max(text) FILTER (role = 'user' AND nth = 2) AS u, max(text) FILTER (role = 'assistant' AND nth = 1) AS a, max(text) FILTER (role = 'assistant' AND nth = 2) AS b FROM k GROUP BY row_id), w AS (SELECT row_id, u, {_CW.format('a')} AS x, {_CW.format('b')} AS y FROM r)
SELECT row_id, coalesce(regexp_matches(u, {_quote(G.CONFUSION['fr'])}) AND len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE < 0.35, false) AS passes FROM w""")
def g8(spark, sf):
    return _gate(spark, sf, lambda m: G.is_learner_adaptation(m, "fr"))


@query("g15_injection", _C + f" SELECT row_id, coalesce(bool_or(regexp_matches(text, {_quote(G.INJECTION)})) FILTER (role = 'user'), false) AS passes FROM c GROUP BY row_id")
def g15(spark, sf):
    return _gate(spark, sf, G.has_injection)


# ---- H: planning ---------------------------------------------------------------------------------------------

_GATES = [("short", "n_chars < 400", 20), ("no_digit", "NOT regexp_like(coalesce(text, ''), '[0-9]')", 30), ("even", "doc_id % 2 = 0", 10)]


def _cascade_sql() -> str:
    sql, last = "WITH s0 AS (SELECT doc_id, lang AS component, text, n_chars, CAST(NULL AS VARCHAR) AS reject_reason FROM documents)", "s0"
    for i, (name, fails, budget) in enumerate(_GATES, 1):
        fails = fails.replace("regexp_like", "regexp_matches")
        sql += f", f{i} AS (SELECT doc_id, row_number() OVER (PARTITION BY component ORDER BY doc_id) AS p FROM {last} WHERE reject_reason IS NULL AND {fails}), s{i} AS (SELECT s.* REPLACE (CASE WHEN f.doc_id IS NOT NULL THEN '{name}' ELSE reject_reason END AS reject_reason) FROM {last} s LEFT JOIN f{i} f ON s.doc_id = f.doc_id AND p <= {budget})"
        last = f"s{i}"
    return sql


def _cascade(spark, sf):
    attempts = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("component"), "text", "n_chars")
    return P.gate_cascade(attempts, [(n, F.expr(f), F.lit(b)) for n, f, b in _GATES], "doc_id")


@query("h3_gate_cascade", _cascade_sql() + " SELECT doc_id, component, reject_reason FROM s3")
def h3(spark, sf):
    return _cascade(spark, sf).select("doc_id", "component", "reject_reason")


@query("h4_attempt_stats", _cascade_sql() + """, g AS (SELECT component, count(*) AS attempts, count(*) FILTER (reject_reason IS NULL) AS accepted, count(*) FILTER (reject_reason = 'short') AS n_short, count(*) FILTER (reject_reason = 'no_digit') AS n_no_digit, count(*) FILTER (reject_reason = 'even') AS n_even FROM s3 GROUP BY 1)
SELECT *, array_to_string(list_filter([CASE WHEN n_short >= 20 THEN 'short' END, CASE WHEN n_no_digit >= 20 THEN 'no_digit' END, CASE WHEN n_even >= 20 THEN 'even' END], lambda x: x IS NOT NULL), ',') AS exhausted FROM g""")
def h4(spark, sf):
    return P.attempt_stats(_cascade(spark, sf), [g[0] for g in _GATES], F.lit(20))


# ---- J, K, L: reports and metrics ----------------------------------------------------------------------------


@query("j6_fact_coverage", "WITH n AS (SELECT DISTINCT item_id AS label, text AS needle FROM benchmark), h AS (SELECT label, count(*) AS hits FROM n JOIN documents ON contains(text, needle) GROUP BY label) SELECT n.label, n.needle, coalesce(hits, 0) AS hits, coalesce(hits, 0) > 0 AS stored FROM n LEFT JOIN h ON n.label = h.label")
def j6(spark, sf):
    needles = table(spark, sf, "benchmark").select(F.col("item_id").alias("label"), F.col("text").alias("needle"))
    return V.fact_coverage(table(spark, sf, "documents").select(F.col("text").alias("content")), needles)


@query("k3_refusal_score", base._RESOLVED + """, d AS (SELECT gold % 2 = 0 AS odd, domain_source = 'no_match' AS nm, query_id % 40 = 0 AS em FROM x)
SELECT count(*) AS n, round(count(*) FILTER (odd AND (nm OR em)) / greatest(count(*) FILTER (odd), 1)::DOUBLE, 6) AS ood_refusal_rate, round(count(*) FILTER (NOT odd AND (nm OR em)) / greatest(count(*) FILTER (NOT odd), 1)::DOUBLE, 6) AS false_refusal_rate,
count(*) FILTER (nm AND em) AS n_both, count(*) FILTER (nm AND NOT em) AS n_no_match_only, count(*) FILTER (em AND NOT nm) AS n_empty_only, count(*) FILTER (NOT nm AND NOT em) AS n_none FROM d""")
def k3(spark, sf):
    decided = R.refusal(base._resolved(spark, sf).withColumn("context_chars", F.when(F.col("query_id") % 40 == 0, 0).otherwise(10)))
    return V.score_refusal(decided.withColumn("expected_refusal", F.col("gold") % 2 == 0))


@query("k5_error_rates")
def k5(spark, sf):
    heard = F.regexp_replace(F.col("content"), "(?i) (de|la|the|der|el) ", " ")
    pairs = _turns(spark, sf).select(F.col("session_id").alias("row_id"), F.col("turn_index").alias("turn"), F.col("content").alias("reference"), heard.alias("hypothesis"))
    return V.error_rates(pairs, ("row_id", "turn"))


def _runs(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(F.col("event_type").alias("engine"), F.col("event_id").alias("id"), (v / 100).alias("raw"), (v / (100 + F.col("event_id") % 7)).alias("norm"))


_RUNS = "WITH r AS (SELECT event_type AS engine, event_id AS id, value / 100 AS raw, value / (100 + event_id % 7) AS norm FROM events)"


@query("k7_engine_verdict", _RUNS + """, g AS (SELECT round(avg(raw) FILTER (engine = 'view'), 3) - round(avg(raw) FILTER (engine = 'click'), 3) AS a, round(avg(norm) FILTER (engine = 'view'), 3) - round(avg(norm) FILTER (engine = 'click'), 3) AS b FROM r)
SELECT round(a, 3) AS raw_gap, round(b, 3) AS norm_gap, CASE WHEN a > 0.05 AND b <= 0.02 THEN 'scoring artefact' WHEN b > 0.02 THEN 'real' ELSE 'small' END AS verdict FROM g""")
def k7(spark, sf):
    return V.engine_verdict(_runs(spark, sf), "view", "click")


@query("k7_largest_drops", _RUNS + " SELECT engine, id, place FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY round(raw - norm, 9) DESC, id) AS place FROM r) WHERE place <= 3")
def k7b(spark, sf):
    return V.largest_drops(_runs(spark, sf)).select("engine", "id", "place")


@query("k8_turn_scores", _C + rf""", a AS (SELECT row_id AS session_id, turn AS turn_index, text, length(regexp_replace(text, '[^?؟]+', '', 'g')) AS question_count, list_distinct(regexp_extract_all(lower(text), '[\pL\pM\pN_]{{4,}}')) AS w FROM c WHERE role = 'assistant'),
b AS (SELECT *, lag(w) OVER (PARTITION BY session_id ORDER BY turn_index) AS p FROM a)
SELECT session_id, turn_index, {base._n(base.LAT)} >= {base._n(base.AR)} AS language_ok, length(regexp_extract(text, '^[^?؟]*')) > 40 AS explains_before_asking, question_count, question_count = 1 AND regexp_matches(right(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 3), '[?؟]') AS ends_with_exactly_one_question,
length(text) AS char_count, CASE WHEN p IS NULL THEN NULL WHEN len(w) = 0 THEN 0.0 ELSE round(len(list_filter(w, lambda x: NOT list_contains(p, x))) / len(w)::DOUBLE, 2) END AS new_word_ratio FROM b""")
def k8(spark, sf):
    return C.score_turns(_turns(spark, sf))


@query("k9_latency", "WITH b AS (SELECT event_type AS language, value, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type, false) AS switched FROM events) SELECT language, switched, count(*) AS n, sum(value::DECIMAL(18, 6))::DOUBLE / count(*) AS mean_seconds FROM b GROUP BY 1, 2")
def k9(spark, sf):
    e = table(spark, sf, "events")
    return V.latency_summary(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_index"), F.col("event_type").alias("language"), F.col("value").alias("seconds")))


def _frames(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_no"), F.col("value").alias("level"))


_ENDS = """WITH t AS (SELECT unnest({thresholds}) AS threshold), f AS (SELECT threshold, user_id AS stream_id, event_id AS frame_no, coalesce(value >= threshold, false) AS loud FROM events CROSS JOIN t),
n AS (SELECT *, coalesce(lag(loud) OVER w <> loud, true)::INT AS new FROM f WINDOW w AS (PARTITION BY threshold, stream_id ORDER BY frame_no)), r AS (SELECT *, sum(new) OVER (PARTITION BY threshold, stream_id ORDER BY frame_no) AS run FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY threshold, stream_id, run ORDER BY frame_no) AS nth FROM r), h AS (SELECT * FROM k WHERE nth = 2), p AS (SELECT *, coalesce(lag(loud) OVER (PARTITION BY threshold, stream_id ORDER BY frame_no), false) AS before FROM h),
e AS (SELECT threshold, stream_id, frame_no, CASE WHEN loud THEN 'speech_start' ELSE 'speech_end' END AS event FROM p WHERE before <> loud)"""


@query("l2_endpoints", _ENDS.format(thresholds="[10.0::DOUBLE]") + " SELECT stream_id, frame_no, event FROM e")
def l2(spark, sf):
    return V.endpoints(_frames(spark, sf), 10.0, 2, 2)


@query("k11_endpoint_sweep", _ENDS.format(thresholds="[5.0::DOUBLE, 10.0, 20.0, 1000000.0]") + ", s AS (SELECT threshold, stream_id, count(*) AS n, min(frame_no) AS first FROM e WHERE event = 'speech_start' GROUP BY 1, 2), g AS (SELECT threshold, count(*) AS n_detected, CAST(sum(n) AS BIGINT) AS n_starts, avg(n) AS mean_starts, avg(first) * 20 AS mean_first_ms FROM s GROUP BY 1) SELECT t.threshold, coalesce(n_detected, 0) AS n_detected, coalesce(n_starts, 0) AS n_starts, mean_starts, mean_first_ms FROM t LEFT JOIN g ON t.threshold = g.threshold")
def k11(spark, sf):
    return V.sweep_endpointing(_frames(spark, sf), [5.0, 10.0, 20.0, 1e6], 2, 2)


@query("k11_level_percentiles", "SELECT p AS point, quantile_cont(value, p) AS level FROM events, (SELECT unnest([0.5::DOUBLE, 0.9, 0.95, 0.99]) AS p) GROUP BY p".replace("quantile_cont(value, p)", "CASE p WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.9 THEN quantile_cont(value, 0.9) WHEN 0.95 THEN quantile_cont(value, 0.95) ELSE quantile_cont(value, 0.99) END"))
def k11_levels(spark, sf):
    return V.level_percentiles(_frames(spark, sf))
