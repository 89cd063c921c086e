"""References to articles, laws, norms and pages: what a text cites, and whether an answer's references are in its source.

Patterns run in Java's regex engine with Unicode classes. Arabic heads match every spelling that folding makes equal, so a
source may drop a hamza or confuse a final letter; what is written out always comes from the templates.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .gates import is_refusal, turns

# Letters that folding makes equal (comparison only), and marks that carry no meaning.
FOLDED = {"إ": "ا", "أ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ئ": "ي", "ؤ": "و", "ة": "ه"}
SPELLINGS = {"ا": "[اإأآٱ]", "ه": "[هة]", "ة": "[ةه]", "ي": "[يىئ]", "و": "[وؤ]"}
MARKS = "\u0640\u064b-\u0655\u0670"
INVISIBLE = MARKS + "\u200b-\u200f\u061c"
DIGITS = "".join(chr(0x0660 + i) for i in range(10)) + "".join(chr(0x06F0 + i) for i in range(10))


def spelled(literal: str) -> str:
    """A pattern of a word in every spelling that folds to the same, with marks between its letters."""
    return "".join(f"{SPELLINGS.get(c, c)}[{MARKS}]*" for c in literal)


class Shape(NamedTuple):
    head: str
    pattern: str
    canonical: str
    gloss: str | None
    law: bool = False


_NUMBER, _DOTTED = r"\s+(\d+)", r"\s+(?:رقم\s+)?([\d\-.]+)"
# The shapes of citable references, Arabic ones with their gloss, then Latin ones.
ARABIC_SHAPES = [
    Shape("المادة", spelled("المادة") + _NUMBER, "المادة {n}", "l-madda {n}"),
    Shape("الفصل", spelled("الفصل") + _NUMBER, "الفصل {n}", "l-fasl {n}"),
    Shape("الباب", spelled("الباب") + _NUMBER, "الباب {n}", "l-bab {n}"),
    Shape("الفقرة", spelled("الفقرة") + _NUMBER, "الفقرة {n}", "l-fiqra {n}"),
    Shape("القسم", spelled("القسم") + _NUMBER, "القسم {n}", "l-9ism {n}"),
    Shape("الملحق", spelled("الملحق") + _NUMBER, "الملحق {n}", "l-mulhaq {n}"),
    Shape("صفحة", spelled("صفحة") + _NUMBER, "صفحة {n}", "safha {n}"),
    Shape("المرسوم", spelled("المرسوم") + _DOTTED, "المرسوم {n}", "l-marsoum {n}"),
    Shape("القرار", spelled("القرار") + _DOTTED, "القرار {n}", "l-9arar {n}"),
    Shape("القانون", spelled("القانون") + r"\s+" + spelled("رقم") + r"\s+(\d+[\-.]\d+)", "القانون رقم {n}", "Loi N° {n}", True),
]
LATIN_SHAPES = [
    Shape("Loi", r"(?i)Loi\s+n[°o]?\s*([\d\-\.]+)", "Loi N° {n}", None, True),
    Shape("ISO", r"ISO\s+(\d{4,5})", "ISO {n}", None),
    Shape("Article", r"(?i)\bArticle\s+(\d+)", "Article {n}", None),
    Shape("Section", r"(?i)\b(?:Section)\s+(\d+)", "Section {n}", None),
    Shape("Chapitre", r"(?i)\b(?:Chapitre|Chapter)\s+(\d+)", "Chapitre {n}", None),
    Shape("Paragraphe", r"(?i)\b(?:Paragraphe|Paragraph)\s+(\d+)", "Paragraphe {n}", None),
    Shape("Annexe", r"(?i)\b(?:Annexe|Annex)\s+(\d+)", "Annexe {n}", None),
    Shape("Décret", r"(?i)\bD[ée]cret\s+n?[°o]?\s*([\d\-\.]+)", "Décret n° {n}", None),
    Shape("EN", r"\bEN\s*(\d{3,5})", "EN {n}", None),
    Shape("P.", r"\b[Pp]\.\s*(\d+)\b", "P. {n}", None),
]
SHAPES = ARABIC_SHAPES + LATIN_SHAPES
# What counts as a reference in an answer, one alternative a line.
_ORDINALS = ("الأول", "الثاني", "الثالث", "الرابع", "الخامس", "السادس", "السابع", "الثامن", "التاسع", "العاشر")
_ORDINALS_F = ("الأولى", "الثانية", "الثالثة", "الرابعة", "الخامسة")
REFERENCE = "(?U)(?:" + "|".join([
    r"\b[A-Z]{2,4}-\d{2,3}\b",
    r"(?:Section|Chapitre|Chapter|Annexe|Annex)\s*\d+",
    "(?:" + "|".join(map(spelled, ("القسم", "الباب", "الملحق"))) + r")\s+(?:\d+|" + "|".join(map(spelled, _ORDINALS)) + ")",
    r"(?:Paragraphe|Paragraph)\s+[A-Z0-9]\b",
    spelled("الفقرة") + r"\s+(?:\d+|" + "|".join(map(spelled, _ORDINALS_F)) + ")",
    r"[Ll]oi\s+N?[°o]?\s*[\d]+[\-.][\d]+",
    r"[Ll]oi\s+n?°?\s*\d{2,}",
    r"ISO\s*\d{4,5}",
    "(?:ال)?" + spelled("قانون") + r"\s+(?:رقم\s*)?[\d]+[\-.][\d]+",
    r"Code\s+du\s+Travail",
    spelled("مدونة") + r"\s+" + spelled("الشغل"),
    spelled("المادة") + r"\s*\d+",
    r"Article\s*\d+",
    "(?:ال)?" + spelled("قانون") + r"(?:\s+\S+){1,3}\s+رقم\s*[\d]+[\-.][\d]+",
    r"\bEN\s*\d{3,5}",
    spelled("الفصل") + r"\s*\d+",
    r"D[ée]cret\s+n?°?\s*[\d\-.]+",
    spelled("صفحة") + r"\s*\d+",
    r"\b[Pp]\.\s*\d+\b",
]) + ")"
CLAIM = (
    r"(?U)\d+[\d,.]*\s*(?:%|ساعة|ساعات|سوايع|يوم|أيام|شهر|أشهر|عام|سنة|سنوات|موظف|عامل|درهم|هكتار|متر|كيلومتر"
    r"|heures?|jours?|semaines?|mois|ans?|employ[ée]s?|dirhams?)"
)
CORRUPTED = r"(?iU)(?:\b(?:l['’]|la|le|les|du|des|au|aux|à\s+la)\s+ال\S*|\b(?:article|loi)\s+ال\S*)"
FRENCH_SPAN = (
    r"(?iU)(?:\b(?:les|la|le|des|du|une|un|de\s+la|d'|l')\s+[a-zA-ZéèêàçôûîïA-Z]{3,}|\b[a-zA-Zéèêàçôûîï]*(?:tion|ité|ance|ence|ement|aire|elle)\b"
    r"|\b(?:EPI|LOTO|ISO|HSE|ATEX|KYC|AML|RGPD|QHSE)\b)"
)
DARIJA_MARK = (
    r"(?iU)(?:\bك[ايتن]\w{2,}|(?:ديال|دياول|باش|بلي|دابا|دبا|بزاف|شوية|واش|فين|منين|شنو|شحال|كيفاش|علاش|حيتاش|حيت|بحال|مزيان|زوين|صافي|يالله|دغيا|زعما|والو|ماشي"
    r"|خاصني|خاصك|خاصو|خاصها|خاصنا|خاصهم|بغيت|بغيتي|بغا|كاين|كاينة|كاينين|غادي|غادية|غاديين|هاد|هادي|هادو|هاداك|ديك|داك|عندي|عندك|عندو|عندها|عندنا|عندهم"
    r"|نقدر|تقدر|يقدر|نقدرو|خلينا|خلي)|\b(?:dyal|daba|bzaf|wach|kayn|chno|fin|mnin|b7al|mzyan|khassek|khassou|khassni|ghadi|had|hadi|kifach|3lach|chwiya|bghit"
    r"|3ndek|machi|walou|7it|z3ma|safi|bach|bli|n9der|t9der)\b)"
)
NOT_WORD = "(?U)[^\\w\u0600-\u06ff]"
QUIZ = "struct<questions: array<struct<question: string, options: array<string>, answer: int, explanation: string>>>"


#: Frequent characters beyond ASCII (Arabic and Latin letters, digits, quotes) that composition leaves alone and that never
#: join what is before, as no ASCII does.
STABLE = "\u0621-\u064a\u0660-\u066d\u0671-\u0674\u0679-\u06d5\u060c\u061b\u061f\u00c0-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u00ab\u00b0\u00bb\u2013\u2014\u2018-\u201e\u20ac"
#: One character of the rest, and a run of them with the character before it, which may take it up.
_CHANGING = r"[\x{80}-\x{10FFFF}&&[^" + STABLE + "]]"
COMPOSED = f"(?s).?{_CHANGING}+"


def beyond_ascii(members: str) -> str:
    """A pattern of one character of a class beyond ASCII. Java tries a class's members one by one, so a single test of the
    character comes first, which nearly all characters of Latin texts end at."""
    return rf"[^\x00-\x7F](?<=[{members}])"


@F.arrow_udf(ArrayType(StringType()))  # a type, not its name: workers import this module without a session
def _nfkc(pieces: pa.Array) -> pa.Array:
    done, values = [], pieces.flatten()
    for at in range(0, len(values), 1024):  # Python's own strings of a slice at a time
        done.append(pa.array([unicodedata.normalize("NFKC", v) for v in values.slice(at, 1024).to_pylist()], pa.string()))
    sizes = [0, *pc.fill_null(pc.list_value_length(pieces), 0).to_pylist()]
    offsets = pa.array(np.cumsum(sizes), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.concat_arrays(done) if done else pa.array([], pa.string()), mask=pieces.is_null())


def normalize_arabic(text: Column) -> Column:
    """Compatibility forms composed (NFKC), tatweel, vowel marks and direction marks dropped: safe to store. Null is empty.
    Only the runs that composition may change reach Python, each with the character before it."""
    text = F.coalesce(text, F.lit(""))
    pieces = _nfkc(F.when(text.rlike(_CHANGING), F.regexp_extract_all(text, F.lit(COMPOSED), F.lit(0))))
    composed = F.array_join(F.zip_with(F.split(text, COMPOSED), pieces, lambda gap, piece: F.concat(gap, F.coalesce(piece, F.lit("")))), "")
    return F.regexp_replace(F.coalesce(composed, text), beyond_ascii(INVISIBLE), "")


def folded(text: Column) -> Column:
    """Letters and digits that comparisons take as equal made equal; marks dropped. Never to be stored or shown."""
    return _letters(F.regexp_replace(text, beyond_ascii(INVISIBLE), ""))


def _letters(plain: Column) -> Column:
    return F.translate(plain, "".join(FOLDED) + DIGITS, "".join(FOLDED.values()) + "0123456789" * 2)


def fold_arabic(text: Column) -> Column:
    return _letters(normalize_arabic(text))


def _first(s: Shape) -> str:
    """A class of a shape's first letter in either case (a long s counts as s)."""
    first = s.head[0]
    return "[" + ("\u0621-\u06ff" if first > "\u00ff" else first.upper() + first.lower() + ("\u017f" if first in "Ss" else "")) + "]"


def searched(s: Shape) -> str:
    """The pattern of a shape behind a test of its first letter: word boundaries and spellings cost many times more and are
    then tried at few places."""
    return f"(?={_first(s)})" + ("(?iU)" if s.pattern.startswith("(?i)") else "(?U)") + s.pattern.removeprefix("(?i)")


def _any_shape() -> str:
    """A pattern, empty but for its group, of a place where some shape stands. No head begins like another and none can stand
    within a match of any shape, so one scan finds what a scan for each shape would. Behind tests of the first letter and of
    the first two, which few places pass."""
    arabic, others, begun = [], [], spelled("ال")
    for s in SHAPES:
        own = s.pattern.removeprefix("(?i)").replace("(\\d", "(?:\\d").replace("([", "(?:[")
        if own.startswith(begun):
            arabic.append(own.removeprefix(begun))
        else:
            others.append(f"(?i:{own})" if s.pattern.startswith("(?i)") else own)
    latin = sorted({(_first(s), s.head[1]) for s in SHAPES if s.head[0] < "\u00ff"})
    firsts = "".join(sorted({f[1:-1] for f, _ in latin})) + "\u0621-\u06ff"
    both = "|".join(f"{f}[{x.upper()}{x.lower()}{'Ee' if x == 'é' else ''}]" for f, x in latin)
    return rf"(?U)(?=[{firsts}])(?={both}|[\u0621-\u06ff])(?=({begun}(?:{'|'.join(arabic)})|{'|'.join(others)}))"


def _entries(found: Column, i: int, s: Shape) -> Column:
    before, after = s.canonical.split("{n}")
    numbers = F.regexp_extract_all(found, F.lit(searched(s)), F.lit(1))

    def entry(n):
        gloss = F.lit(None).cast("string") if s.gloss is None else F.concat(F.lit(s.gloss.split("{n}")[0]), n)
        return F.struct(F.lit(i).alias("shape"), F.lit(s.head).alias("head"), folded(F.replace(n, F.lit("."), F.lit("-")) if s.law else n).alias("key"), F.concat(F.lit(before), n, F.lit(after)).alias("canonical"), gloss.alias("gloss"))

    return F.transform(numbers, entry)


#: Between the references found: in no shape, and neither a letter nor a digit.
_BETWEEN = "|"


def citations_of(text: Column) -> Column:
    """array<struct<shape, head, key, canonical, gloss>> of all references in text, by shape and then by place. One scan
    finds all of them; which shape each has is looked up in what was found alone."""
    found = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_any_shape()), F.lit(1)), _BETWEEN)
    return F.transform(F.array(found), lambda f: F.concat(*[_entries(f, i, s) for i, s in enumerate(SHAPES)]))[0]


def answers_of(messages: Column, component: Column | None = None) -> Column:
    """All assistant turns as one text. A quiz counts with its questions, explanations and right options alone."""
    said = F.array_join(turns(messages, "assistant"), " ")
    if component is None:
        return said
    quiz = F.from_json(said, QUIZ)["questions"]
    parts = F.flatten(F.transform(quiz, lambda q: F.array(F.coalesce(q["question"], F.lit("")), F.coalesce(q["explanation"], F.lit("")), F.coalesce(F.when(q["answer"] >= 0, F.get(q["options"], q["answer"])), F.lit("")))))
    return F.when((component == "quiz_generation") & quiz.isNotNull(), F.array_join(parts, " ")).otherwise(said)


def _compared(text: Column, fold: bool) -> Column:
    bare = F.regexp_replace(text, NOT_WORD, "")
    return F.lower(folded(bare) if fold else bare)


def _missing(said: Column, context: Column, pattern: str, fold: bool) -> Column:
    spans = F.transform(F.regexp_extract_all(said, F.lit(pattern), F.lit(0)), lambda r: F.btrim(F.regexp_replace(r, r"(?U)\s+", " ")))
    haystack = _compared(F.coalesce(context, F.lit("")), fold)
    return F.filter(spans, lambda r: (_compared(r, fold) != "") & (F.instr(haystack, _compared(r, fold)) == 0))


def ungrounded_references(messages: Column, context: Column, component: Column | None = None) -> Column:
    """References of the answers that the context does not have, compared by folded letters and digits alone."""
    return _missing(answers_of(messages, component), context, REFERENCE, True)


def ungrounded_numbers(messages: Column, context: Column) -> Column:
    """Numbers with a unit in the answers that the context does not have."""
    return _missing(answers_of(messages), context, CLAIM, False)


def refusal_cites(messages: Column) -> Column:
    """A refusal that cites something all the same."""
    return is_refusal(messages) & answers_of(messages).rlike(REFERENCE)


def is_corrupted(messages: Column) -> Column:
    """A French determiner or head stands before an Arabic definite noun in some answer."""
    return F.exists(turns(messages, "assistant"), lambda t: t.rlike(CORRUPTED))


def _distinct(text: Column, pattern: str) -> Column:
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda x: F.lower(F.btrim(x)))))


def french_terms(text: Column) -> Column:
    """How many different French-looking spans occur."""
    return _distinct(text, FRENCH_SPAN)


def darija_markers(text: Column) -> Column:
    """How many different words occur that only Darija has."""
    return _distinct(text, DARIJA_MARK)


def arabic_outside_citations(text: Column) -> Column:
    """Arabic letters or digits remain once the Arabic references are taken out."""
    spans = "(?U)(?:" + "|".join(s.pattern.replace("(\\d", "(?:\\d").replace("([", "(?:[") for s in ARABIC_SHAPES) + ")"
    return F.regexp_replace(F.coalesce(text, F.lit("")), spans, "\n").rlike("[\u0621-\u06ff]")


def is_french_clean(messages: Column, french_markers, english_markers, min_french: int = 2, max_english: int = 1) -> Column:
    """Answers without stray Arabic, with French function words and hardly an English one; the markers are column functions."""
    answers, said = turns(messages, "assistant"), answers_of(messages)
    return (F.size(answers) > 0) & ~F.exists(answers, arabic_outside_citations) & (english_markers(said) <= max_english) & (french_markers(said) >= min_french)


def is_code_switched(messages: Column, min_darija: int = 1, min_french: int = 2, min_peak: int = 2) -> Column:
    """Every answer has Darija, all together have French terms, and some answer alone has enough."""
    answers = turns(messages, "assistant")
    return (F.size(answers) > 0) & F.forall(answers, lambda t: darija_markers(t) >= min_darija) & (french_terms(answers_of(messages)) >= min_french) & F.exists(answers, lambda t: french_terms(t) >= min_peak)


def is_grounded_register(messages: Column, min_darija: int = 2) -> Column:
    """Every answer has at least min_darija different Darija markers."""
    answers = turns(messages, "assistant")
    return (F.size(answers) > 0) & F.forall(answers, lambda t: darija_markers(t) >= min_darija)


def is_zero_french_answer(messages: Column) -> Column:
    """Answers without any French term, and no refusal."""
    return ~is_refusal(messages) & (french_terms(answers_of(messages)) == 0)


def has_arabic_script(messages: Column) -> Column:
    """Some answer has an Arabic letter: rows without any are what the strict script policy drops."""
    return F.exists(turns(messages, "assistant"), lambda t: t.rlike("[\u0600-\u06ff]"))
