"""Arabic-script Darija in Latin letters: punctuation, known words and letters, with paired citations left as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation, known words and letters in their Latin form.
PUNCTUATION = {"؟": "?", "،": ",", "؛": ";", "٪": "%", "٫": ".", "٬": ",", "۔": "."}
WORDS = {
    "كيفاش": "kifash", "ماكاينش": "makaynch", "هادشي": "hadchi", "خاصك": "khassek", "علاش": "3lash", "بغيتي": "bghiti", "عندك": "3andek", "عندي": "3andi",
    "مزيان": "mzyan", "واخا": "wakha", "شكون": "chkoun", "ديال": "dyal", "غادي": "ghadi", "ولكن": "walakin", "شوية": "chwiya", "كولشي": "kolchi", "ماشي": "machi",
    "دابا": "daba", "بزاف": "bzaf", "خاص": "khass", "كاين": "kayn", "بغيت": "bghit", "صافي": "safi", "عفاك": "3afak", "زعما": "z3ma", "شنو": "chno", "واش": "wach",
    "حيت": "7it", "باش": "bach", "هادي": "hadi", "هاد": "had", "فين": "fin", "سمح": "smeh", "راه": "rah", "ملي": "mli", "فاش": "fach", "حنا": "7na", "معا": "m3a",
    "على": "3la", "نيت": "nit",
}
LETTERS = {
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "7", "خ": "kh", "د": "d", "ذ": "d", "ر": "r", "ز": "z", "س": "s", "ش": "ch", "ص": "s", "ض": "d", "ط": "t",
    "ظ": "z", "ع": "3", "غ": "gh", "ف": "f", "ق": "9", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y", "ة": "a", "ى": "a", "أ": "a", "إ": "i",
    "ؤ": "o", "ئ": "i", "ء": "2", "آ": "a", "ٱ": "a", "گ": "g", "ڭ": "g", "ڤ": "v", "پ": "p", "ژ": "j", "ﻻ": "la",
    "٠": "0", "١": "1", "٢": "2", "٣": "3", "٤": "4", "٥": "5", "٦": "6", "٧": "7", "٨": "8", "٩": "9",
}
_LETTER, _MARK = "ء-ي", "ًٌٍَُِّْ"
_DIGIT = "٠-٩"
CITED = rf"(?U)([{_LETTER}][{_LETTER}{_DIGIT}{_MARK}]*(?:[  ][{_LETTER}{_DIGIT}\d][{_LETTER}{_DIGIT}{_MARK}\d]*){{0,2}})(?=\s*\([^)]*[A-Za-z][^)]*\))"
DROPPED = "[ً-ْٰـ]"


def to_arabizi(text: Column) -> Column:
    """text in Latin letters; an Arabic term of up to three words before a parenthesis with Latin letters stays as it is.

    Punctuation is always turned; without any Arabic letter left nothing more happens. Then marks go, known words are
    written as usual (longest first), letters one by one, and runs of blanks become one. Null stays null.
    """
    terms = F.transform(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)), lambda t: F.trim(t))
    latin = F.regexp_replace(text, CITED, "\u0000")
    for a, b in PUNCTUATION.items():
        latin = F.replace(latin, F.lit(a), F.lit(b))
    written = F.regexp_replace(latin, DROPPED, "")
    for word in sorted(WORDS, key=len, reverse=True):
        written = F.replace(written, F.lit(word), F.lit(WORDS[word]))
    single = {a: b for a, b in LETTERS.items() if len(b) == 1}
    for a, b in LETTERS.items():
        if len(b) > 1:
            written = F.replace(written, F.lit(a), F.lit(b))
    written = F.trim(F.regexp_replace(F.translate(written, "".join(single), "".join(single.values())), r"[ \t]{2,}", " "))
    done = F.when(latin.rlike("[ء-ۿ]"), written).otherwise(latin)
    # the pieces between the terms, and the terms put back one by one
    pieces = F.split(done, "\u0000")
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(terms, i), F.lit("")))), "")
