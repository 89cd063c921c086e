"""Column functions that tell a message's language and kind by script and closed word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ARABIC_BLOCK, LATIN, count_chars

BLANK_RUN = r"[ \t\n\x0B\f\r]+"
STRIPPED = ".,!?;:()\"'"

# The word lists of the language rules.
ARABIZI = "chno chnou wach wash dyal kayn bghit bghina 3lach kifach kifash 3la hna ndir khass khas walo bzaf daba smiti 3andi mzyan wa5a labas".split()
RESPONSE_VERBS = "reponds repond explique parle ecris dis جاوب جاوبني شرح كتب".split()
DARIJA_PHRASES = ("en darija", "en arabe", "bdarija", "بالدارجة", "بالعربية")
FRENCH_PHRASES = ("en francais", "بالفرنسية")
ANAPHORA = "pourquoi comment quoi explique expliquer donc alors après apres ensuite ça ca ceci cela علاش كيفاش شنو وشنو بعد زيد زيدني".split()
FRENCH_WORDS = (
    "que qui quoi quel quelle quelles quels est sont les des une dans pour avec sur comment pourquoi quand doit peut vous je nous bonjour "
    "merci s'il ce cette ces du au aux et ou un le la de en par plus mais donc aussi tout tous toute toutes faire etre avoir selon entre "
    "apres avant sans sous leur leurs notre votre mon ma mes son sa ses il elle ils elles on peuvent expliquer moi toi lui y veux veuillez svp"
).split()
ENGLISH_WORDS = (
    "the this that these those is are was were and with from your you must should shall will can have has had not does do did for by it be "
    "been being of obtaining explains explain details several following each any which when"
).split()
SHORT_MESSAGE = 4


def tokens(text: Column, stripped: str = STRIPPED) -> Column:
    """Words parted at blanks and hyphens, bare of the stripped characters at both ends, in lower case. Words of
    punctuation alone stay as empty strings, so the array's size is the number of words; null has none."""
    words = F.filter(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("-"), F.lit(" ")), BLANK_RUN), lambda w: w != "")
    return F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(stripped))))


def _list(words) -> Column:
    return F.array(*[F.lit(w) for w in dict.fromkeys(words)])


def detect_query_lang(text: Column) -> Column:
    """'darija' where Arabic characters outnumber ASCII letters or an Arabizi word occurs, else 'fr' (null, empty: 'fr')."""
    arabic = count_chars(text, ARABIC_BLOCK) > count_chars(text, LATIN)
    return F.when(arabic | F.arrays_overlap(tokens(text), _list(ARABIZI)), "darija").otherwise("fr")


def detect_lang_instruction(text: Column) -> Column:
    """'darija' or 'fr' where the message asks to be answered in it, else null.

    The first occurrence of a phrase counts if one of the five words before it is a verb of answering, or if at most
    three characters part it from a clause mark. Phrases for Darija are tried before those for French.
    """
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "éèêàç", "eeeac")

    def asks(phrase):
        at = F.instr(plain, phrase)
        before = F.substring(plain, F.lit(1), at - 1)
        words = tokens(before, STRIPPED + "؟")
        verb = F.arrays_overlap(F.slice(words, F.greatest(F.size(words) - 4, F.lit(1)), 5), _list(RESPONSE_VERBS))
        clause = before.rlike("[,;.؟?]") & (F.length(F.btrim(F.regexp_extract(before, "([^,;.؟?]*)$", 1), F.lit(" \t\n\x0b\f\r"))) <= 3)
        return (at > 0) & (verb | clause)

    def any_of(phrases):
        found = asks(phrases[0])
        for p in phrases[1:]:
            found = found | asks(p)
        return found

    return F.when(any_of(DARIJA_PHRASES), "darija").when(any_of(FRENCH_PHRASES), "fr")


def is_anaphoric(text: Column) -> Column:
    """A message of under four words, or one with an anaphoric word; blank and null messages are not."""
    words = tokens(text, STRIPPED + "؟")
    return (F.size(words) > 0) & ((F.size(words) < SHORT_MESSAGE) | F.arrays_overlap(words, _list(ANAPHORA)))


def french_markers(text: Column) -> Column:
    """How many different French function words occur."""
    return F.size(F.array_intersect(tokens(text), _list(FRENCH_WORDS)))


def english_markers(text: Column) -> Column:
    """How many different English function words occur."""
    return F.size(F.array_intersect(tokens(text), _list(ENGLISH_WORDS)))
