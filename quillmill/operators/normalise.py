"""Generated rows in the shape they are trained in: a user turn in front, the given system text, citations in place, two scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import references as X
from ..functions.rendering import to_arabizi
from .citing import cited_as
from .conversation import row_context, trim_conversation

# Fixed value: how a question, and what ends it, is marked in running text.
QUESTION = r"(?:السؤال|سؤال|Question|So2al|Soal|Q)\s*[:\-]\s*(.*?)(?=(?:الأجوبة|الإجابة|Réponse|Answer|A\s*[:\-]|$))"
#: The system text's own default, the language whose rows keep the citations as they were written, the letters that count.
FRENCH, ARABIC = "fr", "[؀-ۿ]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def embedded_question(text: Column) -> Column:
    """The question that stands in a text: what follows a marker; else the sentences with a question mark; else the last
    line that is not blank. Empty where there is none; null as empty."""
    text = F.coalesce(text, F.lit(""))
    marked = _strip(F.regexp_extract(text, "(?iusdU)" + QUESTION, 1))
    asked = F.filter(F.split(text, r"(?<=[.!\n])"), lambda s: s.rlike("[?؟]"))
    lines = F.filter(F.transform(F.split(text, "\n"), _strip), lambda line: line != "")
    return F.when(marked != "", marked).when(F.size(asked) > 0, F.array_join(F.transform(asked, _strip), " ")).otherwise(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")))


def _message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _capitalised(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    return F.when(first.rlike(r"(?U)^\p{Lower}"), F.concat(F.upper(first), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)


def normalise_rows(rows: DataFrame, system: Column, component: Column, domain: Column, language: Column, messages: str = "messages") -> DataFrame:
    """rows with messages rebuilt and messages_arabizi, component, domain and arabic_script beside them.

    A row without a user turn gets the question that stands in its text as one. System turns and turns without content go;
    a turn without a role is the user's. Answers cite in Arabic letters what the context of the given system text has, but for
    French rows. The second copy is in Latin letters, with paired citations and a capital in front. Both are trimmed to
    whole exchanges and begin with the given system text. What the row is about is taken from the arguments, never from
    the row; rows of a null or empty conversation hold the system text alone.
    """
    given = F.coalesce(F.col(messages), F.array().cast("array<struct<role: string, content: string>>"))
    said = F.array_join(F.transform(given, lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    question = F.when(~F.exists(given, lambda m: F.coalesce(m["role"], F.lit("")) == "user") & (F.size(given) > 0), embedded_question(said)).otherwise("")
    # bound as columns, one after the other, so that each is worked out once
    out = rows.withColumns({"_given": given, "_question": question, "_system": F.coalesce(system, F.lit("")), "_component": component, "_domain": domain, "_french": F.coalesce(language == FRENCH, F.lit(False))})
    asked = F.when(F.col("_question") != "", F.array(_message("user", F.col("_question")))).otherwise(F.slice(F.array(_message("user", F.lit(""))), 1, 0))
    kept = F.filter("_given", lambda m: m["content"].isNotNull() & (F.coalesce(m["role"], F.lit("user")) != "system"))
    context = row_context(F.array(_message("system", F.col("_system"))))
    out = out.withColumns({"_turns": F.concat(asked, F.transform(kept, lambda m: _message(F.coalesce(m["role"], F.lit("user")), m["content"]))), "_cites": X.citations_of(context)})

    def written(m, script: str, text: Column, also: Column) -> Column:
        return _message(m["role"], F.when((m["role"] == "assistant") & also, cited_as(text, F.col("_cites"), F.lit(script))).otherwise(text))

    primary = F.transform("_turns", lambda m: written(m, "arabic", m["content"], ~F.col("_french")))
    latin = F.transform("_turns", lambda m: written(m, "arabizi", to_arabizi(m["content"]), F.lit(True)))
    head = F.array(_message("system", F.col("_system")))
    out = out.withColumns({"_primary": primary, "_latin": F.transform(latin, lambda m: _message(m["role"], _capitalised(m["content"])))})
    own = {messages: F.concat(head, trim_conversation(F.col("_primary"))), f"{messages}_arabizi": F.concat(head, trim_conversation(F.col("_latin"))), "component": F.col("_component"), "domain": F.col("_domain"), "arabic_script": F.exists("_turns", lambda m: m["content"].rlike(ARABIC))}
    return out.withColumns(own).drop("_given", "_question", "_system", "_component", "_domain", "_french", "_turns", "_cites", "_primary", "_latin")
