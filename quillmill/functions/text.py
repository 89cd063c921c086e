"""Column functions over text: script counts, character audits, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC_BLOCK, ARABIC_LETTERS, LATIN = r"\u0600-\u06FF", r"\u0621-\u064A", "A-Za-z"


def count_chars(text: Column, klass: str) -> Column:
    """How many characters of text lie in a regex class; null counts none."""
    return F.coalesce(F.length(F.regexp_replace(text, f"[^{klass}]+", "")), F.lit(0))


def detect_doc_lang(text: Column) -> Column:
    """'ar' where Arabic-block characters outnumber ASCII letters, else 'fr'."""
    return F.when(count_chars(text, ARABIC_BLOCK) > count_chars(text, LATIN), "ar").otherwise("fr")


def is_arabic_doc(text: Column) -> Column:
    """Arabic letters exceed 15 % of the ASCII letters."""
    return count_chars(text, ARABIC_LETTERS) > 0.15 * count_chars(text, LATIN)


def target_script(text: Column) -> Column:
    return F.when(count_chars(text, r"\u0621-\u06FF") > count_chars(text, LATIN), "arabic").otherwise("arabizi")


def arabic_majority(text: Column) -> Column:
    """More words hold an Arabic character than hold an ASCII letter."""
    words = F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+")
    return F.size(F.filter(words, lambda w: w.rlike(f"[{ARABIC_BLOCK}]"))) > F.size(F.filter(words, lambda w: w.rlike("[A-Za-z]")))


def bad_char_ratio(text: Column) -> Column:
    """Share of replacement, control (but \\n \\r \\t) and private-use characters; empty text has 0."""
    bad = count_chars(text, r"\uFFFD\x00-\x08\x0b\x0c\x0e-\x1f\uE000-\uF8FF")
    return bad / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))


def ocr_incomplete(text: Column) -> Column:
    """Text has neither a decimal nor an integer of four digits or more."""
    return ~F.coalesce(text, F.lit("")).rlike(r"[0-9]+[.,][0-9]+|[0-9]{4,}")


def render_rows(messages: Column, add_prompt: bool = False) -> Column:
    """Training text of ordered (role, content) messages: system text opens the first turn, the assistant is 'model'."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")
    turns = F.filter(messages, lambda m: m["role"] != "system")

    def turn(m, i):
        name = F.when(m["role"] == "assistant", "model").otherwise(m["role"])
        head = F.when((i == 0) & (system != ""), F.concat(system, F.lit("\n\n"))).otherwise("")
        return F.concat(F.lit("<start_of_turn>"), name, F.lit("\n"), head, F.trim(m["content"]), F.lit("<end_of_turn>\n"))

    text = F.array_join(F.transform(turns, turn), "")
    return F.concat(text, F.lit("<start_of_turn>model\n")) if add_prompt else text
