"""Documents to chunks: headings, markup, packing, domain tags, domain vocabulary, script runs."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 2000, 250
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
BLANKS = " \t\n\x0b\x0c\r"
HEADING = r"^#{1,6}\s+"
# The tags that are markup (any other <...> is text), and what markup becomes, in the order of application.
TAGS = (
    "table", "thead", "tbody", "tfoot", "tr", "td", "th",
    "p", "div", "span", "br", "hr",
    "h1", "h2", "h3", "h4", "h5", "h6",
    "ul", "ol", "li",
    "b", "i", "em", "strong", "u",
    "a", "img",
)
MARKUP = (
    (r"(?i)</\s*(?:td|th)\s*>", " "),
    (r"(?i)</\s*(?:tr|p|div|li|h[1-6])\s*>|<\s*br\s*/?\s*>", "\n"),
    (r"(?i)</?(?:" + "|".join(TAGS) + r")\b[^<>]*/?>", ""),
    (r"(?md)^#{1,6}\s+", ""),
    (r"(?U)(?<!\w)\*{1,3}(?!\s)([^*]+)(?<!\s)\*{1,3}(?!\w)", "$1"),
    (r"(?U)(?<!\w)_{1,3}(?!\s)([^_]+)(?<!\s)_{1,3}(?!\w)", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"(?md)^>\s+(?!\d)", ""),
    (r"(?md)^[-*_]{3,}\s*$", ""),
    (r"(?md)^\|(?:\s*:?-{3,}:?\s*\|)+\s*$", ""),
    (r"(?<!\\)\|\s*", " "),
    (r"\\\|", "|"),
    (r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)"),
    (r"\n{3,}", "\n\n"),
)


def sections_of(text: Column) -> Column:
    """array<struct<heading, body>> in order: text before the first heading has an empty heading, and without any
    heading the whole text is one section. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, r"(?md)(?=^#{1,6}\s+)")
    

    def section(p):
        headed = p.rlike(HEADING)
        title = F.btrim(F.regexp_extract(p, r"^#{1,6}\s+([^\n]*)", 1), F.lit(BLANKS))
        body = F.when(headed, F.regexp_replace(p, r"^#{1,6}\s+[^\n]*", "")).otherwise(p)
        return F.struct(F.when(headed, title).otherwise("").alias("heading"), F.btrim(body, F.lit(BLANKS)).alias("body"))

    split = F.filter(F.transform(parts, section), lambda s: (s["heading"] != "") | (s["body"] != ""))
    return F.when(text.rlike(r"(?md)^#{1,6}\s+"), split).otherwise(F.array(F.struct(F.lit("").alias("heading"), text.alias("body"))))


def split_headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section_index, heading, body), one row a section; no shuffle."""
    return docs.select(id_col, F.posexplode(sections_of(F.col(text_col))).alias("section_index", "s")).select(id_col, "section_index", "s.heading", "s.body")


def strip_markup(text: Column) -> Column:
    """Text without table cells, tags of TAGS, heading, emphasis, code, quote, rule and table marks; links keep their
    target in brackets. Character references stay (see unescape in chunk_documents)."""
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return F.btrim(text, F.lit(BLANKS))


def split_long(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that parts the text; neighbours share up to
    `overlap` characters of whole parts. A separator stays at the head of the part after it."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    parts = list(text) if sep == "" else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def emit():
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for part in filter(None, parts):
        if len(part) >= size and finer:  # too long for this separator: close what is held, cut the part finer
            emit()
            held, length = [], 0
            out += split_long(part, size, overlap, finer)
            continue
        if held and length + len(part) > size:
            emit()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    emit()
    return out


def pack(sections: list[dict], size: int, overlap: int) -> list[tuple[str, str, int]]:
    """(content, heading, section_index) chunks: small neighbours share a chunk, a section over `size` is split alone
    and each of its pieces repeats the heading."""
    chunks: list[tuple[str, str, int]] = []
    open_parts: list[str] = []
    used, head, first = 0, "", 0

    def close():
        if open_parts:
            chunks.append(("\n\n".join(open_parts), head, first))
        open_parts.clear()

    for i, s in enumerate(sections):
        title, body = s["heading"], html.unescape(s["body"]).replace("\xa0", " ").strip()
        piece = "\n\n".join(x for x in (title, body) if x)
        if not piece:
            continue
        if len(piece) > size:
            close()
            chunks += [("\n\n".join(x for x in (title, p) if x), title, i) for p in split_long(body or title, size, overlap)]
            continue
        if open_parts and used + len(piece) + 2 > size:
            close()
        if not open_parts:
            used, head, first = 0, title, i
        open_parts.append(piece)
        used += len(piece) + 2
    close()
    return chunks


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, section_index, heading, content) of every document; null and blank texts give no chunk.

    Headings and markup are handled by column functions; only the packing is Python, over Arrow batches, one document
    at a time and without a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.transform(sections_of(F.col(text_col)), lambda s: F.struct(s["heading"].alias("heading"), strip_markup(s["body"]).alias("body"))).alias("sections"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, sections in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for k, chunk in enumerate(pack(sections, size, overlap)):
                    ids.append(i.as_py())
                    out.append((k, chunk[2], chunk[1], chunk[0]))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], [id_col, "chunk_index", "section_index", "heading", "content"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, section_index int, heading string, content string")


def tag_domain(files: DataFrame, default: str, explicit: str | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """files (path, …) with domain and fell_back: the folder above /text/ (through aliases), else explicit, else default."""
    found = F.regexp_extract(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), r"([^/]+)/text/[^/]+\.md$", 1)
    names = aliases or {}
    named = F.coalesce(*[F.when(found == k, F.lit(v)) for k, v in names.items()], F.when(found != "", found))
    return files.withColumn("domain", F.coalesce(named, F.lit(explicit).cast("string"), F.lit(default))).withColumn("fell_back", named.isNull() & F.lit(explicit is None))


# Terms and acronyms that carry no technical meaning.
TERM_STOPS = [
    "le cas", "les cas", "des cas", "la mise", "le code", "du code", "la page", "le present", "la presente", "les presentes", "du present", "la partie", "les parties",
    "le cadre", "du cadre", "la suite", "le fait", "les faits", "la date", "du texte", "le texte", "la loi", "du travail", "de la", "des travailleurs",
]
ACRONYM_STOPS = "DE LA LE LES DU DES ET OU PROJET LOI ARTICLE CHAPITRE TITRE SECTION PC TC".split()
TERM = r"(?iU)\b((?:le|la|les|l'|du|des)\s+[a-zà-ÿ]{4,}(?:\s+[a-zà-ÿ]{4,})?)"
ACRONYM = r"(?U)\b([A-Z]{2,6}(?:\s?\d{4,5})?)\b"


def mine_terms(docs: DataFrame, terms: int = 14, acronyms: int = 6) -> DataFrame:
    """(domain, kind, term, n, place): the most frequent terms after an article and acronyms of each domain, ties by
    term; those that occur once count only where none occurs twice. Counts are partial before the shuffle."""
    plain = F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(1)), lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    upper = F.transform(F.regexp_extract_all("text", F.lit(ACRONYM), F.lit(1)), lambda t: F.btrim(t))
    tagged = F.concat(
        F.transform(F.filter(plain, lambda t: ~t.isin(TERM_STOPS)), lambda t: F.struct(F.lit("term").alias("kind"), t.alias("term"))),
        F.transform(F.filter(upper, lambda t: ~t.isin(ACRONYM_STOPS)), lambda t: F.struct(F.lit("acronym").alias("kind"), t.alias("term"))),
    )
    counts = docs.select("domain", F.explode(tagged).alias("x")).groupBy("domain", F.col("x.kind").alias("kind"), F.col("x.term").alias("term")).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("domain", "kind").orderBy(F.desc("n"), "term"))
    ranked = counts.withColumn("place", best).where(F.col("place") <= max(terms, acronyms))  # a rank limit before the next window
    most = F.max("n").over(Window.partitionBy("domain", "kind"))
    limit = F.when(F.col("kind") == "term", terms).otherwise(acronyms)
    return ranked.withColumn("most", most).where((F.col("place") <= limit) & (F.col("n") >= F.least(F.col("most"), F.lit(2)))).drop("most")


def script_spans(docs: DataFrame, first: str = r"[\x{0600}-\x{06FF}]", second: str = "[A-Za-z]", names: tuple[str, str] = ("ar", "fr"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, span_no, lang, text): runs of words of one script; a word of neither joins the run before it (the first
    words join the run that follows; a text with neither is one run of the second script). A letter for each word stands for
    its script, and a pattern over the letters finds the runs, so each row is cut by itself and nothing is shuffled."""
    bind = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  value is computed once
    kind = lambda w: F.when(w.rlike(first), "a").when(w.rlike(second), "b").otherwise("-")
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")

    def spans(words):
        runs = F.regexp_extract_all(F.array_join(F.transform(words, kind), ""), F.lit("^-+$|(?:^-+)?(?:a[a-]*|b[b-]*)"), F.lit(0))
        each = lambda r, said: F.struct(F.when(F.contains(r, F.lit("a")), names[0]).otherwise(names[1]).alias("lang"), said.alias("text"))
        return bind(runs, lambda runs: F.when(F.size(runs) > 0, F.zip_with(runs, told(words, runs), each)))

    def told(words, runs):  # a line for each run: no word has a line end
        before = F.flatten(F.transform(runs, lambda r: F.concat(F.array(F.lit("\n")), F.array_repeat(F.lit(" "), F.length(r) - 1))))
        return F.split(F.substr(F.array_join(F.zip_with(before, words, lambda b, w: F.concat(b, w)), ""), F.lit(2)), "\n")

    each = docs.select(id_col, F.posexplode(bind(words, spans)).alias("span_no", "s"))
    return each.select(id_col, F.col("span_no").cast("long").alias("span_no"), "s.lang", "s.text")
