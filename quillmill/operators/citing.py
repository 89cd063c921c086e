"""Citations as rows: what a document cites, whether answers cite it, rewriting, recall and the preflight report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import references as X

# How answers name an article or a law in Latin letters.
ARTICLE_MENTION = r"\b(?:l[-\s]?|al[-\s]?|la\s+)?(madda|mada|madda|fasl|bab|fiqra|article|article)\s*(?:n[°o]?\s*)?(\d+)\b"
HEAD_OF = {"madda": "المادة", "mada": "المادة", "article": "المادة", "fasl": "الفصل", "bab": "الباب", "fiqra": "الفقرة"}
LAW_MENTION = r"\b(?:mchrw3\s+)?(?:al[-\s]?)?(?:9anwn|qanoun|qanun|kanoun|loi)\s*(?:r9m|raqm|n[°o]\.?|no\.?)?\s*(\d+[\-.]\d+)"
LAW_HEADS = ("القانون", "Loi")
#: All forms of a mention: the two above, and the canonical forms in Arabic letters, however they are spelled.
MENTION = "(?iU)" + "|".join([ARTICLE_MENTION, LAW_MENTION, *(X.spelled(s.canonical.removesuffix("{n}")) + r"[\d\-.]*\d" for s in X.ARABIC_SHAPES)])


def extract_citations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, head, key, canonical, gloss): each reference of a document once; of several spellings of one reference the
    last stands. A document without references, a null or empty text gives no row; rows of one id count as one document."""
    found = docs.select(F.col(id_col), F.posexplode(X.citations_of(F.col(text_col))).alias("place", "c"))
    last = F.max_by(F.struct("c.canonical", "c.gloss"), F.struct("c.shape", "place")).alias("last")
    return found.groupBy(id_col, F.col("c.head").alias("head"), F.col("c.key").alias("key")).agg(last).select(id_col, "head", "key", "last.canonical", "last.gloss")


def row_cites(rows: DataFrame, id_col: str = "row_id", messages: str = "messages", context: str = "context") -> DataFrame:
    """rows with n_citable, the references of their context, and cites: whether an answer holds the canonical form or the
    gloss of one. Rows are met by id with what their own context cites, a few forms a row."""
    cited = extract_citations(rows, id_col, context).groupBy(id_col).agg(F.flatten(F.collect_list(F.array_compact(F.array("canonical", "gloss")))).alias("_forms"), F.count("*").alias("_n"))
    said = X.answers_of(F.col(messages))
    joined = rows.join(cited, id_col, "left")
    return joined.withColumn("n_citable", F.coalesce("_n", F.lit(0))).withColumn("cites", F.coalesce(F.exists("_forms", lambda f: F.contains(said, f)), F.lit(False))).drop("_forms", "_n")


def citation_recall(cited: DataFrame) -> DataFrame:
    """(component, citable, cited, recall) over the rows of row_cites() whose context cites anything."""
    return cited.where("n_citable > 0").groupBy("component").agg(F.count("*").alias("citable"), F.count_if("cites").alias("cited"), F.avg(F.col("cites").cast("int")).alias("recall"))


def preflight(rows: DataFrame) -> DataFrame:
    """One row of the hard gates over (row_id, component, messages, context): citation recall of quiz rows (must be 1),
    share of socratic rows of several turns (reported), corrupted rows (must be 0), and the verdict."""
    quiz, talk = F.col("component") == "quiz_generation", F.col("component") == "socratic"
    answers = F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    sums = row_cites(rows).agg(
        F.count_if(quiz & (F.col("n_citable") > 0)).alias("citable"), F.count_if(quiz & (F.col("n_citable") > 0) & F.col("cites")).alias("cited"),
        F.avg(F.when(talk, (answers > 1).cast("int"))).alias("multi_turn_share"), F.count_if(X.is_corrupted(F.col("messages"))).alias("corrupted"),
    )
    return sums.withColumn("recall", F.when(F.col("citable") > 0, F.col("cited") / F.col("citable")).otherwise(1.0)).withColumn("passed", (F.col("cited") == F.col("citable")) & (F.col("corrupted") == 0))


def _let(value: Column, body) -> Column:
    """Bind value once within an expression: body gets a reference to it."""
    return F.transform(F.array(value), body)[0]


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def _mentions(found: Column, cites: Column) -> Column:
    """What each mention of found (said, gaps) is: its kind, the citation it names (null for none), a name for the reference
    that all its forms share, whether it is the gloss of a pair that stands already, and whether a parenthesis follows."""

    def one(said, i):
        word, number = (F.regexp_extract(said, f"(?iU)^(?:{ARTICLE_MENTION})$", g) for g in (1, 2))
        law = F.replace(F.regexp_extract(said, f"(?iU)^(?:{LAW_MENTION})$", 1), F.lit("."), F.lit("-"))
        heads = F.create_map(*[F.lit(x) for pair in HEAD_OF.items() for x in pair])
        named = lambda head, key: _last(F.filter(cites, lambda c: (c["head"] == head) & (c["key"] == key)))
        kind = F.when(word != "", "article").when(law != "", "law").otherwise("written")
        entry = F.when(word != "", named(heads[F.lower(word)], number)).when(law != "", F.coalesce(*[named(F.lit(h), law) for h in LAW_HEADS])).otherwise(_last(F.filter(cites, lambda c: X.folded(c["canonical"]) == X.folded(said))))
        gaps = found["gaps"]
        before = F.concat(F.coalesce(F.get(found["said"], i - 1), F.lit("")), F.get(gaps, i))

        def described(c):
            name = F.concat_ws("|", F.when(c["head"].isin(*LAW_HEADS), F.lit("law")).otherwise(c["head"]), c["key"])
            paired = X.folded(F.regexp_replace(before, r"(?U)\s+$", "")).endswith(X.folded(F.concat(c["canonical"], F.lit(" ("))))
            return F.struct(said.alias("said"), kind.alias("kind"), number.alias("number"), c["canonical"].alias("canonical"), c["gloss"].alias("gloss"), name.alias("name"), (F.coalesce(paired, F.lit(False)) & (kind != "written")).alias("paired"), F.get(gaps, i + 1).rlike(r"(?U)^\s*\(").alias("open"))

        return _let(entry, described)

    return F.transform(found["said"], one)


def cited_as(text: Column, citations: Column, script: Column) -> Column:
    """text with every article or law that citations (array<struct<head, key, canonical, gloss>>) holds in the form for script:
    arabic (canonical), french, or arabizi (paired with its gloss at the first mention, the gloss later; the first mention in
    Arabic letters gets its gloss too). A pair that stands already, and what the source does not cite, stays as it is.

    One pattern finds all forms of mentions in one scan; each is decided by what it names, what stands around it and which
    ones came before; the text is put together once. Null stays null.
    """
    cites = F.transform(citations, lambda c: F.struct(*[c[f].cast("string").alias(f) for f in ("head", "key", "canonical", "gloss")]))
    found = F.struct(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)).alias("said"), F.split(text, MENTION).alias("gaps"))

    def written(found, mentions):
        def form(m, i):
            pair = F.when(m["gloss"].isNull() | (m["gloss"] == m["canonical"]), m["canonical"]).otherwise(F.concat(m["canonical"], F.lit(" ("), m["gloss"], F.lit(")")))
            short, earlier = F.coalesce(m["gloss"], m["canonical"]), F.slice(mentions, 1, i)
            glossed = lambda o: (o["kind"] == "written") & ~o["open"] & o["gloss"].isNotNull()
            met = F.exists(earlier, lambda o: (o["name"] == m["name"]) & ((o["kind"] != "written") | glossed(o)))
            first = ~F.exists(earlier, lambda o: (o["name"] == m["name"]) & glossed(o))
            latin = F.when(script == "arabic", m["canonical"]).when(script == "french", F.when(m["kind"] == "article", F.concat(F.lit("Article "), m["number"])).otherwise(short)).when(met, short).otherwise(pair)
            own = F.when((script == "arabizi") & glossed(m) & first, pair).otherwise(m["said"])
            return F.when(m["canonical"].isNull() | m["paired"], m["said"]).when(m["kind"] == "written", own).otherwise(latin)

        return F.concat(F.get(found["gaps"], F.lit(0)), F.array_join(F.transform(F.transform(mentions, form), lambda said, i: F.concat(said, F.get(found["gaps"], i + 1))), ""))

    done = _let(found, lambda f: _let(_mentions(f, cites), lambda m: written(f, m)))
    return F.when(F.size(cites) > 0, done).otherwise(text)


def inject_citations(rows: DataFrame, citations: Column, text: Column, script: Column) -> DataFrame:
    """rows with `rewritten`, cited_as() of text. Repeated rows repeat their result."""
    return rows.withColumn("rewritten", cited_as(text, citations, script))
