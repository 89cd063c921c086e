"""Registered queries over citations, grounding, recovered rows, quizzes and near rows, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import gates as G
from ..functions import references as X
from ..functions.rendering import to_arabizi
from ..operators import citing as C
from ..operators import evaluation as V
from ..operators import ingest as I
from ..operators import near_rows as N
from ..operators import pages as P
from ..operators import recovery as R
from ..operators import retrieval as T
from ..operators.rows import has_cjk
from ..sources import files as S
from ..streaming import progress as B
from . import registered as base
from .catalogue import query, table
from .registered_text import _every, _items, _quote, _tok

# Java's Unicode classes and RE2's ASCII ones agree on texts whose own characters are ASCII, so the driver's are made so.
_ASCII = "regexp_replace(coalesce(text, ''), '[^ -~]', 'x'{g})"

# ---- B: Arabic letters and citations -----------------------------------------------------------------------------

_MARKED = "concat('الـمَادَّة ', doc_id % 9, ' إلى آخره ٥ ', {t})"


@query("b9_arabic_folds", "SELECT doc_id, concat('المادة ', doc_id % 9, ' إلى آخره ٥ ', t) AS normal, concat('الماده ', doc_id % 9, ' الي اخره 5 ', t) AS folded FROM (SELECT doc_id, " + _ASCII.format(g=", 'g'") + " AS t FROM documents)")
def b9(spark, sf):
    text = F.expr(_MARKED.format(t=_ASCII.format(g="")))
    return table(spark, sf, "documents").select("doc_id", X.normalize_arabic(text).alias("normal"), X.fold_arabic(text).alias("folded"))


_CITING = "concat('article ', doc_id % 50, ' puis Loi n° 4', doc_id % 3, '.1', doc_id % 2, ', loi n° 4', doc_id % 3, '-1', doc_id % 2, ' ISO 45001; المادة ', doc_id % 7, ' و القانون رقم 27.0', doc_id % 5, ' p. ', doc_id % 4, ' Décret n° 2-', doc_id % 3, ' EN 16', doc_id % 2 + 10, ' Chapter ', doc_id % 2, ' ', {t})"


def _citations_sql(source: str, key: str) -> str:
    parts = []
    for i, s in enumerate(X.SHAPES):
        flags = "(?i)" if s.pattern.startswith("(?i)") else ""
        found = f"regexp_extract_all(t, {_quote(flags + s.pattern.removeprefix('(?i)'))}, 1)"
        number = "replace(n, '.', '-')" if s.law else "n"
        gloss = "NULL" if s.gloss is None else f"concat({_quote(s.gloss.split('{n}')[0])}, n)"
        parts.append(f"SELECT {key}, {i} AS shape, place, {_quote(s.head)} AS head, {number} AS key, concat({_quote(s.canonical.split('{n}')[0])}, n) AS canonical, {gloss} AS gloss FROM (SELECT {key}, unnest({found}) AS n, generate_subscripts({found}, 1) AS place FROM {source})")
    return " UNION ALL ".join(parts)


@query("b10_citations", "WITH d AS (SELECT doc_id, " + _CITING.format(t=_ASCII.format(g=", 'g'")) + " AS t FROM documents), a AS (" + _citations_sql("d", "doc_id") + ") SELECT doc_id, head, key, canonical, gloss FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, head, key ORDER BY shape DESC, place DESC) = 1")
def b10(spark, sf):
    return C.extract_citations(table(spark, sf, "documents").select("doc_id", F.expr(_CITING.format(t=_ASCII.format(g=""))).alias("text")))


# The law is cited as 4x.y and mentioned as 4x-y; article 3 is in the source, article 30 is not.
_ANSWER = "concat('voir l-madda 3, almada 30 puis fasl 3 et qanoun 4', doc_id % 3, '-10; encore madda 3. ', regexp_replace(coalesce(source, ''), '[^a-z0-9]', ''))"
_GOT = {
    "arabic": "concat('voir المادة 3, almada 30 puis fasl 3 et ', law, '; encore المادة 3. ', s)",
    "french": "concat('voir Article 3, almada 30 puis fasl 3 et ', fr, '; encore Article 3. ', s)",
    "arabizi": "concat('voir المادة 3 (l-madda 3), almada 30 puis fasl 3 et ', law, if(fr <> law, ' (' || fr || ')', ''), '; encore l-madda 3. ', s)",
}


@query("b11_rewritten_citations", "WITH d AS (SELECT doc_id, regexp_replace(coalesce(source, ''), '[^a-z0-9]', '', 'g') AS s, CASE WHEN doc_id % 3 = 0 THEN 'القانون رقم 40.10' ELSE 'qanoun 4' || doc_id % 3 || '-10' END AS law, CASE WHEN doc_id % 3 = 0 THEN 'Loi N° 40.10' ELSE 'qanoun 4' || doc_id % 3 || '-10' END AS fr FROM documents) SELECT doc_id, CASE doc_id % 2 + doc_id % 4 // 2 WHEN 0 THEN " + _GOT["arabic"] + " WHEN 1 THEN " + _GOT["french"] + " ELSE " + _GOT["arabizi"] + " END AS rewritten FROM d")
def b11(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_ANSWER).alias("answer"), F.expr("CASE doc_id % 2 + doc_id % 4 div 2 WHEN 0 THEN 'arabic' WHEN 1 THEN 'french' ELSE 'arabizi' END").alias("script"))
    cited = X.citations_of(F.lit("المادة 3 و القانون رقم 40.10"))
    return C.inject_citations(rows, cited, F.col("answer"), F.col("script")).select("doc_id", "rewritten")


# ---- G: gates ------------------------------------------------------------------------------------------------

_PLANT = """CASE WHEN role = 'assistant' AND conv_id % 6 = 0 THEN concat('Désolé. ', {t}, ' Article ', conv_id % 9) WHEN role = 'assistant' AND conv_id % 6 = 1 THEN concat({t}, ' Loi n° 42-1', conv_id % 4, ' et ISO 9001, 30 jours, ', conv_id % 40, ' heures. المادة 5')
WHEN role = 'assistant' AND conv_id % 6 = 2 THEN concat('wach daba la formation est une obligation, qui est dans les documents. ', {t}) WHEN role = 'assistant' AND conv_id % 6 = 3 THEN concat('la المادة dit que les SEC-0', conv_id % 5, ' sont pour vous et avec nous. ', {t})
WHEN role = 'assistant' AND conv_id % 6 = 4 THEN concat('Que sont les regles pour vous. ', substr({t}, 1, 5)) ELSE {t} END"""
_CONTEXT = "concat('Article ', conv_id % 5, '. Loi N° 42-12 ; ISO 9001, delai 30 jours. SEC-01 SEC-02 ', if(conv_id % 2 = 0, 'المادة 5', ''))"
_COMPONENT = "CASE WHEN conv_id % 3 = 0 THEN 'quiz_generation' WHEN conv_id % 3 = 1 THEN 'socratic' ELSE 'code_switching' END"
_S = f"WITH c AS (SELECT conv_id AS row_id, turn, role, {_PLANT.format(t=_ASCII.format(g=', ' + _quote('g')))} AS text, {_CONTEXT} AS context, {_COMPONENT} AS component FROM conversations), s AS (SELECT row_id, any_value(component) AS component, any_value(context) AS context, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS said, count(*) FILTER (role = 'assistant') AS n FROM c GROUP BY row_id)"


def _planted(spark, sf):
    from ..operators.rows import rows_from_turns

    t = table(spark, sf, "conversations").withColumn("text", F.expr(_PLANT.format(t=_ASCII.format(g=""))))
    keys = t.select(F.col("conv_id").alias("row_id"), F.expr(_CONTEXT).alias("context"), F.expr(_COMPONENT).alias("component")).distinct()
    return rows_from_turns(t).join(keys, "row_id")


_KEY = r"lower(regexp_replace({}, '[^\pL\pM\pN_\x{{0600}}-\x{{06FF}}]', '', 'g'))"


def _missing(pattern: str) -> str:
    spans = rf"list_transform(regexp_extract_all(said, {_quote(pattern.removeprefix('(?U)'))}), lambda r: trim(regexp_replace(r, '\s+', ' ', 'g')))"
    fold = lambda x: f"replace({x}, 'ة', 'ه')" if pattern == X.REFERENCE else x
    return f"array_to_string(list_filter({spans}, lambda r: {_KEY.format('r')} <> '' AND NOT contains({fold(_KEY.format('context'))}, {fold(_KEY.format('r'))})), '|')"


@query("g12_ungrounded_references", _S + f" SELECT row_id, {_missing(X.REFERENCE)} AS offenders FROM s")
def g12(spark, sf):
    return _planted(spark, sf).select("row_id", F.array_join(X.ungrounded_references(F.col("messages"), F.col("context")), "|").alias("offenders"))


@query("g13_ungrounded_numbers", _S + f" SELECT row_id, {_missing(X.CLAIM)} AS offenders FROM s")
def g13(spark, sf):
    return _planted(spark, sf).select("row_id", F.array_join(X.ungrounded_numbers(F.col("messages"), F.col("context")), "|").alias("offenders"))


def _gate(name, test, gate):
    @query(name, f"{_S} SELECT row_id, {test} AS passes FROM s")
    def run(spark, sf):
        return _planted(spark, sf).select("row_id", gate(F.col("messages")).alias("passes"))

    return run


def _over_turns(name, test, gate):
    @query(name, f"{_S} SELECT row_id, {test} AS passes FROM c GROUP BY row_id")
    def run(spark, sf):
        return _planted(spark, sf).select("row_id", gate(F.col("messages")).alias("passes"))

    return run


_REFUSES = _every(f"regexp_matches(text, {_quote(G.REFUSAL)})")
_SAID = "coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '')"
_RE2 = lambda p: _quote(p.removeprefix("(?U)").replace("(?iU)", "(?i)"))
_TERMS = lambda t: f"len(list_distinct(list_transform(regexp_extract_all({t}, {_RE2(X.FRENCH_SPAN)}), lambda x: lower(trim(x)))))"
_DARIJA = lambda t: f"len(list_distinct(list_transform(regexp_extract_all({t}, {_RE2(X.DARIJA_MARK)}), lambda x: lower(trim(x)))))"
_SPANS = "(?:" + "|".join(s.pattern.replace("(\\d", "(?:\\d").replace("([", "(?:[") for s in X.ARABIC_SHAPES) + ")"
_STRAY = rf"regexp_matches(regexp_replace(text, {_quote(_SPANS)}, chr(10), 'g'), '[\x{{0621}}-\x{{06FF}}]')"

g1 = _over_turns("g1_french_clean", f"count(*) FILTER (role = 'assistant') > 0 AND NOT coalesce(bool_or({_STRAY}) FILTER (role = 'assistant'), false) AND len(list_intersect({_tok(_SAID)}, {_items(L.ENGLISH_WORDS)})) <= 1 AND len(list_intersect({_tok(_SAID)}, {_items(L.FRENCH_WORDS)})) >= 2", lambda m: X.is_french_clean(m, L.french_markers, L.english_markers))
g2 = _over_turns("g2_code_switched", f"{_every(_DARIJA('text') + ' >= 1')} AND {_TERMS(_SAID)} >= 2 AND coalesce(bool_or({_TERMS('text')} >= 2) FILTER (role = 'assistant'), false)", X.is_code_switched)
g3 = _over_turns("g3_grounded_register", _every(_DARIJA("text") + " >= 2"), X.is_grounded_register)
g10 = _over_turns("g10_refusal_cites", f"{_REFUSES} AND regexp_matches({_SAID}, {_RE2(X.REFERENCE)})", X.refusal_cites)
g17 = _over_turns("g17_corrupted", f"coalesce(bool_or(regexp_matches(text, {_RE2(X.CORRUPTED)})) FILTER (role = 'assistant'), false)", X.is_corrupted)
g19 = _over_turns("g19_arabic_script", r"coalesce(bool_or(regexp_matches(text, '[\x{0600}-\x{06FF}]')) FILTER (role = 'assistant'), false)", X.has_arabic_script)
g21 = _over_turns("g21_zero_french", f"NOT {_REFUSES} AND {_TERMS(_SAID)} = 0", X.is_zero_french_answer)

_CITES = _S + ", t AS (SELECT row_id, context AS t FROM s), a AS (" + _citations_sql("t", "row_id") + """), k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY row_id, head, key ORDER BY shape DESC, place DESC) = 1),
g AS (SELECT s.row_id, component, s.n, count(head) AS n_citable, coalesce(bool_or(contains(said, canonical) OR contains(said, coalesce(gloss, canonical))), false) AS cites FROM s LEFT JOIN k ON s.row_id = k.row_id GROUP BY s.row_id, component, s.n)"""


@query("g11_row_cites", _CITES + " SELECT row_id, n_citable, cites FROM g")
def g11(spark, sf):
    return C.row_cites(_planted(spark, sf)).select("row_id", "n_citable", "cites")


@query("j4_citation_recall", _CITES + " SELECT component, count(*) AS citable, count(*) FILTER (cites) AS cited, avg(cites::INT) AS recall FROM g WHERE n_citable > 0 GROUP BY component")
def j4(spark, sf):
    return C.citation_recall(C.row_cites(_planted(spark, sf)))


@query("j3_preflight", _CITES + f", x AS (SELECT count(*) AS corrupted FROM (SELECT row_id FROM c WHERE role = 'assistant' GROUP BY row_id HAVING bool_or(regexp_matches(text, {_RE2(X.CORRUPTED)})))), q AS (SELECT count(*) FILTER (component = 'quiz_generation' AND n_citable > 0) AS citable, count(*) FILTER (component = 'quiz_generation' AND n_citable > 0 AND cites) AS cited, avg((n > 1)::INT) FILTER (component = 'socratic') AS multi_turn_share FROM g) SELECT citable, cited, multi_turn_share, corrupted, if(citable > 0, cited / citable::DOUBLE, 1.0) AS recall, cited = citable AND corrupted = 0 AS passed FROM q CROSS JOIN x")
def j3(spark, sf):
    return C.preflight(_planted(spark, sf))


# ---- F: recovered rows and quizzes ----------------------------------------------------------------------------

_M = "md5(coalesce(text, ''))"
_DAMAGED = f"""CASE doc_id % 7 WHEN 0 THEN concat('{{"messages": [{{"role": "user", "content": "', {_M}, '"}}]}}') WHEN 1 THEN concat('Sure: ```json {{"messages": [{{"role": "user", "content": "', {_M}, '"}}]}}```')
WHEN 2 THEN concat('{{"messages": [{{"role": "user", "content": "', {_M}, '"}},]}}') WHEN 3 THEN concat('{{"messages": [{{"role": "user", "content": "', {_M}, '".}}]}}') WHEN 4 THEN concat('{{"messages": [{{"role": "user", "content": "', substr({_M}, 1, 9))
WHEN 5 THEN concat('{{"messages": [{{"content": "', {_M}, '", "role": "user"}}, {{"role" "x"}}]') ELSE 'nothing here' END"""


@query("f1_recovered_json", f"SELECT doc_id, CASE WHEN doc_id % 7 < 4 THEN {_M} WHEN doc_id % 7 = 4 THEN substr({_M}, 1, 9) END AS content, CASE WHEN doc_id % 7 < 2 THEN 'raw' WHEN doc_id % 7 < 4 THEN 'fixed' WHEN doc_id % 7 = 4 THEN 'balanced' END AS tier FROM documents")
def f1(spark, sf):
    got = R.recover_json(table(spark, sf, "documents").select(F.col("doc_id"), F.expr(_DAMAGED).alias("response")), "doc_id")
    return got.select("doc_id", F.get_json_object("json", "$.messages[0].content").alias("content"), "tier")


@query("f2_salvaged_turns", f"SELECT doc_id, 0 AS conversation, 1 AS n, 'user' AS role, {_M} AS content FROM documents WHERE doc_id % 7 IN (0, 1, 2, 3, 5)")
def f2(spark, sf):
    got = R.salvage(table(spark, sf, "documents").select("doc_id", F.expr(_DAMAGED).alias("response")), "doc_id")
    return got.select("doc_id", "conversation", F.size("messages").alias("n"), F.get("messages", F.lit(0))["role"].alias("role"), F.get("messages", F.lit(0))["content"].alias("content"))


def _quizzes(spark, sf):
    options = F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta")))
    at = F.col("doc_id") + F.col("p")
    q = F.struct(F.concat(F.lit("Q"), (F.col("p") % 2).cast("string")).alias("question"), options.alias("options"), (at % 5).cast("int").alias("answer"), F.concat(F.lit("because "), F.get(options, (at % 4).cast("int")), F.lit(" SEC-0"), (at % 3).cast("string")).alias("explanation"))
    each = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("p")).select("doc_id", "source", F.struct("p", q.alias("q")).alias("x"))
    rows = each.groupBy(F.col("doc_id").alias("quiz_id")).agg(F.first("source").alias("request"), F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("quiz_id", "request", F.transform("x", lambda x: x["q"]).alias("questions"), F.lit("SEC-00 and SEC-01 apply").alias("context"))


_Q = "WITH q AS (SELECT doc_id AS quiz_id, source, p, doc_id + p AS a FROM documents, range(6) t(p)), v AS (SELECT *, a % 5 < 4 AND a % 5 = a % 4 AS valid, a % 3 = 2 AS off FROM q)"


@query("g20_judged_questions", _Q + ", k AS (SELECT *, row_number() OVER (PARTITION BY quiz_id, p % 2, valid AND NOT off ORDER BY p) AS nth FROM v) SELECT quiz_id, CAST(p AS INT) AS place, CASE WHEN NOT valid THEN 'invalid_structure' WHEN off THEN 'ungrounded_reference' WHEN nth > 1 THEN 'repeated' END AS reason, CASE WHEN valid AND off THEN 'SEC-02' END AS offenders FROM k")
def g20(spark, sf):
    got = R.judge_questions(_quizzes(spark, sf))
    return got.select("quiz_id", "place", "reason", F.array_join("offenders", "|").alias("offenders"))


@query("f8_quiz_rows", _Q + ", g AS (SELECT quiz_id, any_value(source) AS source, count(*) FILTER (valid) AS n FROM v GROUP BY 1) SELECT quiz_id, CASE WHEN length(trim(source)) >= 15 THEN trim(source) ELSE ['Quiz, please, on this text', 'Five questions on it, please'][('0x' || substr(md5('42|' || quiz_id), 1, 8))::BIGINT % 2 + 1] END AS request, n FROM g WHERE n > 0")
def f8(spark, sf):
    got = R.quiz_rows(_quizzes(spark, sf), ["Quiz, please, on this text", "Five questions on it, please"])
    parsed = F.from_json(F.col("messages")[1]["content"], X.QUIZ)["questions"]
    return got.select("quiz_id", F.col("messages")[0]["content"].alias("request"), F.size(parsed).cast("long").alias("n"))


# ---- I: near rows ---------------------------------------------------------------------------------------------

_NEAR = 0.35
_PAIRS = "SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 10 == 0, "eval").otherwise("train").alias("split"))


@query("i2_near_pairs", f"SELECT i, j, round(s, 9) AS similarity FROM ({_PAIRS}) WHERE s >= {_NEAR}")
def i2_pairs(spark, sf):
    return N.near_pairs(_vectors(spark, sf), _NEAR, every=True).select("i", "j", F.round("similarity", 9).alias("similarity"))


@query("i2_near_dedup")
def i2(spark, sf):
    return N.near_dedup(_vectors(spark, sf), _NEAR).select("ord")


@query("i5_leakage_pairs", f"SELECT if(i % 10 = 0, j, i) AS train, if(i % 10 = 0, i, j) AS eval, round(s, 9) AS similarity FROM ({_PAIRS}) WHERE s >= {_NEAR} AND (i % 10 = 0) <> (j % 10 = 0)")
def i5(spark, sf):
    return N.leakage_pairs(_vectors(spark, sf), _NEAR, every=True).select("train", "eval", F.round("similarity", 9).alias("similarity"))


@query("c6_embedded")
def c6(spark, sf):
    return N.embed(table(spark, sf, "documents").select("doc_id", "text"), F.col("text")).select("doc_id", "vector")


# ---- A, B, E, J, K: files, pages, segments, reports ---------------------------------------------------------------


@query("a6_csv_markdown", "SELECT n_nationkey % 3 AS part, concat('# part', n_nationkey % 3, chr(10), '| key | name |', chr(10), string_agg(concat('| ', n_nationkey, ' | ', n_name, '\\| |'), chr(10) ORDER BY n_nationkey)) AS markdown FROM nation GROUP BY n_nationkey % 3")
def a6(spark, sf):
    folder = S.scratch_path(spark, "tables")
    cells = F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit('|"')))
    lines = table(spark, sf, "nation").groupBy((F.col("n_nationkey") % 3).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda x: x["c"]), "\n;\n").alias("body"))
    lines.select("part", F.concat(F.lit("\ufeffkey;name\n"), "body").alias("value")).write.partitionBy("part").option("lineSep", "\n").text(f"{folder}/raw")
    # Spark names its own files, so the stems come from the folders
    got = S.csv_to_markdown(spark, _renamed(spark, f"{folder}/raw"))
    return got.select(F.regexp_extract("file", "part([0-9])[.]csv$", 1).cast("int").alias("part"), "markdown")


def _renamed(spark, folder: str) -> str:
    """The text files of partitioned folders as part<value>.csv, one each."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for d in fs.listStatus(path(folder)):
        name = d.getPath().getName()
        if name.startswith("part="):
            for f in fs.listStatus(d.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), path(f"{folder}/part{name[5:]}.csv"))
    return folder


@query("b13_arabizi", "SELECT doc_id, trim(regexp_replace(concat('kifash? المادة 18 (l-madda 18) 5 daba, ', t), '[ \\t]{2,}', ' ', 'g')) AS written FROM (SELECT doc_id, " + _ASCII.format(g=", 'g'") + " AS t FROM documents)")
def b13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", to_arabizi(F.concat(F.lit("كيفاش؟ المادة 18 (l-madda 18) ٥ دابا، "), F.expr(_ASCII.format(g="")))).alias("written"))


_PAGE = "page_id % 30 AS doc, page_id AS page, CASE WHEN page_id % 30 = 7 OR page_id % 5 = 0 THEN 'ocr_required' WHEN page_id % 5 = 1 THEN 'ocr_preferred' WHEN page_id % 5 = 2 THEN 'empty' ELSE 'native' END AS strategy, url AS native, CASE WHEN page_id % 30 <> 7 AND page_id % 3 > 0 THEN concat(' seen ', page_id) END AS ocr, CASE WHEN page_id % 3 = 0 OR page_id % 30 = 7 THEN 'unavailable' END AS error"


@query("b21_assembled_pages", f"""WITH p AS (SELECT {_PAGE} FROM pages), t AS (SELECT *, coalesce(CASE strategy WHEN 'empty' THEN '' WHEN 'ocr_required' THEN trim(ocr) WHEN 'ocr_preferred' THEN concat_ws(chr(10) || chr(10), trim(native), trim(ocr)) ELSE trim(native) END, '') AS t FROM p)
SELECT doc, string_agg(concat('## Page ', page, chr(10), chr(10), t), chr(10) || chr(10) ORDER BY page) AS text, count(*) FILTER (t = '') AS n_unprocessed, count(*) AS page_count, count(*) FILTER (strategy <> 'native') AS ocr_pages,
CASE WHEN count(*) FILTER (strategy <> 'native') = 0 THEN 'pdf_text' WHEN count(*) FILTER (strategy <> 'native') = count(*) THEN 'pdf_ocr' ELSE 'pdf_mixed' END AS parser, bool_and(t = '') AND bool_or(strategy LIKE 'ocr%' AND error IS NOT NULL) AS failed,
coalesce(string_agg(CASE WHEN strategy = 'empty' THEN 'empty_page' WHEN strategy LIKE 'ocr%' AND error IS NOT NULL THEN error ELSE 'no_text_extracted' END, '|' ORDER BY page) FILTER (t = ''), '') AS reasons FROM t GROUP BY doc""")
def b21(spark, sf):
    got = P.assemble_pages(table(spark, sf, "pages").select(*[F.expr(e) for e in _split_exprs(_PAGE)]))
    return got.select("doc", "text", F.size("unprocessed").cast("long").alias("n_unprocessed"), "page_count", "ocr_pages", "parser", "failed", F.array_join(F.transform("unprocessed", lambda u: u["reason"]), "|").alias("reasons"))


def _split_exprs(sql: str) -> list[str]:
    """The expressions of a select list: commas within brackets do not part them."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(sql[last:i])
            last = i + 1
    return [*out, sql[last:]]


def _segment_turns(spark, sf):
    t = table(spark, sf, "conversations").where("role = 'user'")
    return t.select(
        F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("turn_index"), F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "et pourquoi ?").otherwise(F.col("text")).alias("content"), F.when(F.col("conv_id") % 7 == F.col("turn"), "darija").otherwise("fr").alias("query_lang"),
        F.when(F.col("conv_id") % 5 == F.col("turn"), "law").alias("requested_domain"), F.when(F.col("turn") % 4 < 2, "law").otherwise("tax").alias("routed_domain"), F.lit("retrieval").alias("routed_source"), F.concat(F.lit("v"), F.floor(F.col("turn") / 6).cast("string")).alias("corpus_version"),
        F.when(F.col("conv_id") % 4 != F.col("turn") % 4, F.concat(F.lit("about "), F.substring("text", 1, 20))).otherwise("").alias("probe_context"), F.array(F.concat(F.lit("s"), (F.col("turn") % 5).cast("string")), F.concat(F.lit("s"), (F.col("conv_id") % 5).cast("string"))).alias("probe_sources"),
    )


_REPORT = {"multi_turn": ("component = 'socratic'", "n > 1", "at_least 0.5"), "zero_french": ("component <> 'socratic'", f"{_TERMS('said')} = 0", "at_most 0.8"), "arabic": ("true", r"regexp_matches(said, '[\x{0600}-\x{06FF}]')", "at_least 0.1"), "none": ("n < 0", "true", "at_least 1.0")}


@query("j2_quality_report", _S + " SELECT metric, avg(test::INT) FILTER (among) AS value, count(*) FILTER (among) AS n, bound, CASE WHEN count(*) FILTER (among) = 0 THEN 'empty' WHEN if(bound LIKE 'at_least%', avg(test::INT) FILTER (among) >= split_part(bound, ' ', 2)::DOUBLE, avg(test::INT) FILTER (among) <= split_part(bound, ' ', 2)::DOUBLE) THEN 'go' ELSE 'no_go' END AS verdict FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {a} AS among, {t} AS test, '{b}' AS bound FROM s" for m, (a, t, b) in _REPORT.items()) + ") GROUP BY metric, bound")
def j2(spark, sf):
    m, c = F.col("messages"), F.col("component")
    answers = G.turns(m, "assistant")
    tests = {
        "multi_turn": (c == "socratic", F.size(answers) > 1, "at_least", 0.5), "zero_french": (c != "socratic", X.french_terms(X.answers_of(m)) == 0, "at_most", 0.8),
        "arabic": (F.lit(True), X.has_arabic_script(m), "at_least", 0.1), "none": (has_cjk(m) & F.lit(False), F.lit(True), "at_least", 1.0),
    }
    return V.quality_report(_planted(spark, sf), tests)


@query("k5_normalised_rates")
def k5n(spark, sf):
    pairs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("المادة؛ "), "text").alias("reference"), F.concat(F.lit("الماده "), F.upper("text")).alias("hypothesis"))
    return V.error_rates(pairs, normalise=True)


@query("k10_ocr_gates", "SELECT doc_id, doc_id % 4 IN (0, 3) AS order_pass, doc_id % 4 <> 3 AS digit_integrity_pass FROM documents")
def k10(spark, sf):
    head = F.substring(F.expr(_ASCII.format(g="")), 1, 60)
    gold = F.concat(F.lit("المادة 1 "), head, F.lit(" المادة 2"))
    read = F.when(F.col("doc_id") % 4 == 0, gold).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("المادة 2 "), head, F.lit(" المادة 1"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("المادة 1 "), head)).otherwise(F.concat(F.lit("المادة ١ "), head, F.lit(" المادة 2")))
    return V.ocr_gates(table(spark, sf, "documents"), gold, read, ("doc_id",)).select("doc_id", "order_pass", "digit_integrity_pass")


_JOBS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'pending' ELSE 'error' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders"


def _jobs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


@query("c11_job_queue", f"WITH j AS ({_JOBS}) SELECT id, row_number() OVER (ORDER BY created_at, id) AS place FROM j WHERE status = 'pending'")
def c11_queue(spark, sf):
    return I.job_queue(_jobs(spark, sf), "pending").select("id", "place")


@query("c12_toggle_source", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN false ELSE o_orderkey % 2 = 0 END AS enabled FROM orders")
def c12_toggle(spark, sf):
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 == 0).alias("enabled"))
    return I.toggle_source(files, table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")), False)


_ASKED = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 5, 6) WHEN doc_id % 7 = 1 THEN 'not in any text' END AS gold_substring, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS context, CASE WHEN doc_id % 3 = 0 THEN 'ar' WHEN doc_id % 3 = 1 THEN 'fr' END AS top_script, CASE WHEN doc_id % 4 = 0 THEN 'darija' ELSE 'fr' END AS query_lang, doc_id % 6 > 0 AS has_gold FROM documents"


@query("k1_retrieval_rates", f"WITH a AS ({_ASKED}) SELECT count(*) FILTER (gold_substring IS NOT NULL AND contains(context, gold_substring)) / greatest(count(gold_substring), 1)::DOUBLE AS substring_rate, count(*) FILTER (top_script IS NOT NULL AND top_script <> query_lang AND NOT (top_script = 'ar' AND query_lang = 'darija')) / greatest(count(top_script), 1)::DOUBLE AS cross_language_rate, count(*) FILTER (NOT has_gold AND trim(coalesce(context, '')) = '') / greatest(count(*) FILTER (NOT has_gold), 1)::DOUBLE AS empty_context_rate FROM a")
def k1_rates(spark, sf):
    asked = table(spark, sf, "documents").select(*[F.expr(e) for e in _split_exprs(_ASKED.removeprefix("SELECT ").removesuffix(" FROM documents"))])
    return T.retrieval_rates(asked)


@query("c16_reembedded", "SELECT count(*) FILTER (doc_id % 4 = 0) AS archived, count(*) FILTER (doc_id % 4 > 0) AS total, count(*) FILTER (doc_id % 4 > 0) AS with_vector FROM documents")
def c16(spark, sf):
    chunks = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("domain"), F.col("text").alias("content"), F.array(F.lit(0.0)).alias("vector"))
    return N.reembed(chunks, S.scratch_path(spark, "reembedded"))


@query("d8_local_domain", "SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'general' END AS domain, CASE WHEN doc_id % 3 = 0 THEN 'page_context' ELSE 'tenant_default' END AS domain_source FROM documents")
def d8_local(spark, sf):
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("domain"))
    return T.resolve_domain(asked, None, "general", indexed=False)


@query("l1_progress_states", """WITH a AS (SELECT event_type AS component, count(*) AS n, max(ts) AS row_ts FROM events WHERE event_id % 3 = 0 AND NOT (event_type = 'click' AND ts > (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)) GROUP BY 1), t AS (SELECT event_type AS component, count(*) AS n_attempts, max(ts) AS try_ts FROM events GROUP BY 1), m AS (SELECT max(ts) AS newest FROM events),
g AS (SELECT DISTINCT event_type AS component, CASE WHEN event_type = 'purchase' THEN 5 ELSE 1000000 END AS target FROM events UNION ALL SELECT 'none', 3) SELECT g.component, coalesce(n, 0) AS n, target, coalesce(n_attempts, 0) AS n_attempts, CASE WHEN coalesce(n, 0) >= target THEN 'target met' WHEN date_diff('second', row_ts, newest) <= 90000 THEN 'running' WHEN date_diff('second', try_ts, newest) <= 90000 THEN 'nothing_accepted' ELSE 'no_attempts' END AS state FROM g LEFT JOIN a USING (component) LEFT JOIN t USING (component) CROSS JOIN m""")
def l1_states(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("component"), "ts", "event_id")
    span = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    half = F.timestamp_seconds((F.unix_timestamp("lo") + F.unix_timestamp("hi")) / 2)
    rows = e.join(F.broadcast(span.select(half.alias("mid")))).where((F.col("event_id") % 3 == 0) & ~((F.col("component") == "click") & (F.col("ts") > F.col("mid"))))
    targets = e.select("component").distinct().withColumn("target", F.when(F.col("component") == "purchase", 5).otherwise(1000000)).union(spark.createDataFrame([("none", 3)], "component string, target int"))
    return B.progress_states(B.progress_counts(rows), B.progress_counts(e), targets, 90000, 90000)


@query("l6_accept_rates", "SELECT event_type AS component, time_bucket(INTERVAL '10 minutes', ts) AS window_start, count(*) AS attempts, count(*) FILTER (value > 50) AS accepted, count(*) FILTER (value > 50) / count(*)::DOUBLE AS rate FROM events GROUP BY 1, 2")
def l6_rates(spark, sf):
    return B.accept_rates(table(spark, sf, "events").select(F.col("event_type").alias("component"), "ts", (F.col("value") > 50).alias("accepted")))
