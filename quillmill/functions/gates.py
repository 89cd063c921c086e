"""Quality gates: boolean columns over a row's messages (array<struct<role, content>>) or a quiz question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .language import BLANK_RUN, FRENCH_WORDS

# The patterns and word lists of the gates.
REFUSAL = (
    r"(?i)(سمح\s*ليا|كنعتذر|عذرا|المعذرة|ماشي\s*داخل|ماشي\s*ف\s*نطاق|ما\s*لقيت|مالقيت|ماشي\s*فالمجال|ما\s*نقدرش|مانقدرش|معنديش|ما\s*عنديش"
    r"|ما\s*كاينش|ماكاينش|ما\s*توفرش|ما\s*فيهش|خارج\s*نطاق|ما\s*عندي\s*هاد|je\s*ne\s*peux|ما\s*كايبانش|ما\s*ذكرش|ما\s*تكلمش|ما\s*جاش|لا\s*يتضمن"
    r"|ما\s*فيه\s*حتى|d[ée]sol[ée]|malheureusement|je\s*n['’]ai\s*pas|je\s*ne\s*dispose\s*pas|ne\s*(pr[ée]cise|mentionne|contient|indique|figure)\s*pas"
    r"|ne\s*fait\s*pas\s*partie|hors\s*de\s*(mon|notre)\s*domaine|je\s*ne\s*trouve\s*pas|n['’]est\s*pas\s*mentionn|n['’]est\s*pas\s*disponible)"
)
DISCLOSURE = {
    "darija": r"(ماشي\s*من\s*(?:وثائق|مستندات)\s*الشركة|ماشي\s*من\s*النص|معلومة\s*عامة|بصفة\s*عامة|بشكل\s*عام|هادشي\s*خارج\s*عن\s*(?:وثائق|مستندات)|ماشي\s*مبني\s*على\s*(?:وثائق|مستندات)\s*الشركة)",
    "fr": r"(?i)(ne\s*provient\s*pas\s*des?\s*documents?\s*(de\s*l['’]entreprise|disponibles?)|ceci\s*n['’]est\s*pas\s*(issu|tir[ée])\s*d[eu]s?\s*documents?|information\s*g[ée]n[ée]rale"
    r"|de\s*mani[èe]re\s*g[ée]n[ée]rale|d['’]une\s*mani[èe]re\s*g[ée]n[ée]rale|en\s*dehors\s*des?\s*documents?|ne\s*fait\s*pas\s*partie\s*des?\s*documents?)",
}
CONFUSION = {
    "darija": r"(ما\s*فهمت|مازال\s*ما|ما\s*فهمتش|صعيب|عاود\s*ليا|وضح\s*لي|ما\s*وضحش|بطريقة\s*أسهل|ماشي\s*واضح)",
    "fr": r"(?i)(je\s*ne\s*comprends\s*(toujours\s*)?pas|c['’]est\s*pas\s*clair|pas\s*tr[èe]s\s*clair|expliquer\s*plus\s*simplement|j['’]ai\s*du\s*mal|je\s*ne\s*saisis\s*pas"
    r"|pas\s*s[ûu]r\s*de\s*comprendre|pouvez[\s-]vous\s*(r[ée]expliquer|reformuler)|c['’]est\s*confus)",
}
INJECTION = r"(?i)(ignore|override|forget everything|system override|تجاهل|انسى)"
STRUCTURE = r"(?md)(^\s{0,3}#{1,6}\s+\S|^\s*[-*•]\s+\S|^\s*\d+[.)]\s+\S)"
FILLERS = (
    "واخا خاصنا نعرفو بلي كتعني هادو هوما كاينين حسب على من في ف ديال ديالك ديالو و ولكن عموما واش دابا هاد هادي هادشي لي اللي ما لا لكن او ولا غير a"
).split() + FRENCH_WORDS
TRANSLATED_THEN_BRACKETED = r"[\u0600-\u06FF]{3,}[\u0600-\u06FF\s]*\(\s*(?:les?|la|du|de)?\s*[A-Za-z][^)]{2,}\)"
MAX_OVERLAP, MIN_STRUCTURE_WORDS = 0.35, 150
CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯]"


def turns(messages: Column, role: str) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: F.coalesce(m["content"], F.lit("")))


def every_answer(messages: Column, test) -> Column:
    """There is an assistant turn, and test holds for each."""
    answers = turns(messages, "assistant")
    return (F.size(answers) > 0) & F.forall(answers, test)


def is_refusal(messages: Column) -> Column:
    return every_answer(messages, lambda t: t.rlike(REFUSAL))


def discloses_general_knowledge(messages: Column, language: str = "darija") -> Column:
    return every_answer(messages, lambda t: t.rlike(DISCLOSURE[language]))


def lacks_structure(messages: Column, min_words: Column | int = MIN_STRUCTURE_WORDS) -> Column:
    """Some answer of more than min_words words has no heading, bullet or numbered line."""
    floor = min_words if isinstance(min_words, Column) else F.lit(min_words)
    words = lambda t: F.size(F.filter(F.split(t, BLANK_RUN), lambda w: w != ""))
    return F.exists(turns(messages, "assistant"), lambda t: (words(t) > floor) & ~t.rlike(STRUCTURE))


def is_question_only(text: Column) -> Column:
    """Asks, without any clause of four words or more that does not ask."""
    states = F.exists(F.split(text, r"[.!\n]"), lambda c: ~c.rlike("[?؟]") & (F.size(F.filter(F.split(c, BLANK_RUN), lambda w: w != "")) >= 4))
    return text.rlike("[?؟]") & ~states


def is_socratic(messages: Column) -> Column:
    """Some answer asks and none only asks."""
    return every_answer(messages, lambda t: ~is_question_only(t)) & F.exists(turns(messages, "assistant"), lambda t: t.rlike("[?؟]"))


def content_words(text: Column) -> Column:
    """Different words of three characters or more that are no fillers."""
    fillers = F.array(*[F.lit(w) for w in dict.fromkeys(FILLERS)])
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(fillers, F.lower(w))))


def is_learner_adaptation(messages: Column, language: str = "darija") -> Column:
    """The second user turn shows confusion and the second answer shares under 35 % of its content words with the first."""
    asked, answered = turns(messages, "user"), turns(messages, "assistant")
    a, b = content_words(F.get(answered, 0)), content_words(F.get(answered, 1))
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    confused = (F.size(asked) >= 2) & (F.size(answered) >= 2) & F.get(asked, 1).rlike(CONFUSION[language])
    return F.coalesce(confused & (F.size(a) > 0) & (F.size(b) > 0) & (overlap < MAX_OVERLAP), F.lit(False))


def has_injection(messages: Column) -> Column:
    return F.exists(turns(messages, "user"), lambda t: t.rlike(INJECTION))


def translates_then_brackets(messages: Column) -> Column:
    """Some answer follows an Arabic run by a parenthesised Latin gloss."""
    return F.exists(turns(messages, "assistant"), lambda t: t.rlike(TRANSLATED_THEN_BRACKETED))


def valid_quiz(q: Column) -> Column:
    """Of struct<question, options, answer, explanation>: four different options that are not blank, an answer among
    them, no CJK, and an explanation whose words of four characters or more do not speak for another option."""
    options = F.transform(q["options"], lambda o: F.trim(F.coalesce(o, F.lit(""))))
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"([\p{L}\p{M}\p{N}_]{4,})"), F.lit(1)))
    said = words(q["explanation"])
    shared = F.transform(options, lambda o: F.size(F.array_intersect(said, words(o))))
    agrees = F.coalesce(F.get(shared, q["answer"]) == F.array_max(shared), F.lit(False))
    shape = (F.size(options) == 4) & q["answer"].between(0, 3) & (F.size(F.array_distinct(F.transform(options, F.lower))) == 4) & F.forall(options, lambda o: o != "")
    clean = ~F.coalesce(q["question"], F.lit("")).rlike(CJK) & ~F.exists(options, lambda o: o.rlike(CJK))
    return F.coalesce(shape & clean & (F.size(said) > 0) & agrees, F.lit(False))
