"""Conversation state in batch: replay windows, appended turns, trimmed rows, condensed queries, turn scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import detect_lang_instruction, detect_query_lang, is_anaphoric
from ..functions.text import ARABIC_BLOCK, LATIN, count_chars

MAX_MESSAGES, MAX_CHARS = 4, 2400


def _positions(messages: Column, role: str) -> Column:
    """0-based positions of a role's messages."""
    return F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == role, i)), lambda i: i.isNotNull())


def _between(messages: Column) -> Column:
    """From the first user message to the last answer after it; empty if there is none."""
    first, last = F.array_min(_positions(messages, "user")), F.array_max(_positions(messages, "assistant"))
    return F.when(last > first, F.slice(messages, first + 1, last - first + 1)).otherwise(F.slice(messages, 1, 0))


def replay_window(turns: DataFrame, scope: tuple[str, ...] = ("session_id",), max_messages: int = MAX_MESSAGES, max_chars: int = MAX_CHARS) -> DataFrame:
    """(scope, messages): what of each scope is replayed to the model, from turns (scope, turn_index, role, content).

    Of the newest 3 * max_messages turns, those from the first user's to the last answer; of these the last
    max_messages, without a leading answer; then pairs are dropped from the front while the characters exceed max_chars.
    The rank limit is applied before the rows are gathered, so a long session never becomes one array.
    """
    age = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("turn_index")))
    recent = turns.withColumn("_age", age).where(F.col("_age") <= 3 * max_messages)
    rows = recent.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("turn_index", "role", F.coalesce("content", F.lit("")).alias("content")))).alias("m"))
    rows = rows.withColumn("m", _between(F.col("m")))
    size = F.size("m")
    rows = rows.withColumn("m", F.slice("m", F.greatest(size - max_messages + 1, F.lit(1)), max_messages))
    rows = rows.withColumn("m", F.when(F.get("m", F.lit(0))["role"] != "user", F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0)))).otherwise(F.col("m")))
    chars = lambda e: F.aggregate(F.slice("m", 2 * e + 1, F.size("m")), F.lit(0), lambda a, x: a + F.length(x["content"]))
    evict = F.array_min(F.filter(F.sequence(F.lit(0), F.floor(F.size("m") / 2).cast("int")), lambda e: (chars(e) <= max_chars) | (F.size("m") - 2 * e < 2)))
    kept = F.slice("m", 2 * evict + 1, F.size("m"))
    return rows.select(*scope, F.transform(kept, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def append_exchanges(turns: DataFrame, new: DataFrame) -> DataFrame:
    """(session_id, turn_index, role, content) of new exchanges (session_id, ord, question, answer), numbered on from
    the largest turn_index of the session; a session without turns starts at 1."""
    last = turns.groupBy("session_id").agg(F.max("turn_index").alias("last"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ord")) - 1
    numbered = new.withColumn("_place", place).join(last, "session_id", "left")
    base = F.coalesce("last", F.lit(0)) + 1 + 2 * F.col("_place")
    pair = F.array(F.struct(base.alias("turn_index"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct((base + 1).alias("turn_index"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return numbered.select("session_id", F.explode(pair).alias("x")).select("session_id", "x.*")


def trim_conversation(messages: Column) -> Column:
    """From the first user message to the last answer, neighbours of one role joined by a line break."""
    kept = _between(messages)
    starts = F.filter(F.transform(kept, lambda m, i: F.when((i == 0) | (F.coalesce(F.get(kept, i - 1)["role"], F.lit("")) != m["role"]), i)), lambda i: i.isNotNull())

    def run(s, k):
        end = F.coalesce(F.get(starts, k + 1), F.size(kept))
        return F.struct(F.get(kept, s)["role"].alias("role"), F.array_join(F.transform(F.slice(kept, s + 1, end - s), lambda m: m["content"]), "\n").alias("content"))

    return F.transform(starts, run)


def row_context(messages: Column, marker: str = "CONTEXTE :\n") -> Column:
    """What follows the marker in the first system message, all of it without a marker; empty without a system message."""
    system = F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == "system"), 0)["content"], F.lit(""))
    at = F.instr(system, marker)
    return F.when(at > 0, F.substring(system, at + len(marker), F.length(system))).otherwise(system)


def condense_queries(turns: DataFrame) -> DataFrame:
    """User turns with `query`: an anaphoric message is searched together with the user turn before it."""
    before = F.lag("content").over(Window.partitionBy("session_id").orderBy("turn_index"))
    users = turns.where("role = 'user'").withColumn("_before", before)
    joined = F.coalesce("_before", F.lit("")) != ""
    return users.withColumn("query", F.when(joined & is_anaphoric(F.col("content")), F.concat_ws(" ", "_before", "content")).otherwise(F.col("content"))).drop("_before")


def score_turns(turns: DataFrame, arabic_expected: Column | None = None) -> DataFrame:
    """Answers (session_id, turn_index) with language_ok, explains_before_asking, question_count,
    ends_with_exactly_one_question, char_count, and new_word_ratio against the answer before (null for the first)."""
    text = F.coalesce("content", F.lit(""))
    arabic, latin = count_chars(text, ARABIC_BLOCK), count_chars(text, LATIN)
    asked = F.length(F.regexp_replace(text, "[^?؟]+", ""))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]{4,})"), F.lit(1)))
    answers = turns.where("role = 'assistant'").withColumn("_words", words)
    before = F.lag("_words").over(Window.partitionBy("session_id").orderBy("turn_index"))
    fresh = F.when(F.size("_words") == 0, 0.0).otherwise(F.round(F.size(F.array_except("_words", "_before")) / F.size("_words"), 2))
    expected = F.lit(False) if arabic_expected is None else arabic_expected
    return answers.withColumn("_before", before).select(
        "session_id", "turn_index", F.when(expected, arabic > latin).otherwise(latin >= arabic).alias("language_ok"),
        (F.length(F.regexp_extract(text, "^([^?؟]*)", 1)) > 40).alias("explains_before_asking"), asked.alias("question_count"),
        ((asked == 1) & F.substring(F.btrim(text, F.lit(" \t\n\x0b\f\r")), -3, 3).rlike("[?؟]")).alias("ends_with_exactly_one_question"),
        F.length(text).alias("char_count"), F.when(F.col("_before").isNotNull(), fresh).alias("new_word_ratio"),
    )


def resolve_languages(turns: DataFrame) -> DataFrame:
    """User turns with query_lang, response_lang and response_lang_source.

    turns: (session_id, turn_index, role, content, explicit_language or null). An explicit language is both languages and
    ends any override; an instruction in the message is answered and stays in force (sticky) while the messages keep their
    own language; otherwise the answer follows the message's language (script).
    """
    order = Window.partitionBy("session_id").orderBy("turn_index")
    users = turns.where("role = 'user'").withColumn("_own", detect_query_lang(F.col("content"))).withColumn("_explicit", F.col("explicit_language").isNotNull())
    users = users.withColumn("_asked", F.when(~F.col("_explicit"), detect_lang_instruction(F.col("content"))))
    # a run of turns that can share an override ends at an explicit turn and where the message's language changes
    breaks = F.col("_explicit") | F.coalesce(F.lag("_explicit").over(order), F.lit(True)) | (F.col("_own") != F.lag("_own").over(order))
    users = users.withColumn("_run", F.sum(breaks.cast("int")).over(order))
    kept = F.last("_asked", ignorenulls=True).over(Window.partitionBy("session_id", "_run").orderBy("turn_index"))
    users = users.withColumn("_kept", F.when(~F.col("_explicit"), kept))
    return users.select(
        "session_id", "turn_index", F.coalesce("explicit_language", "_own").alias("query_lang"), F.coalesce("explicit_language", "_kept", "_own").alias("response_lang"),
        F.when(F.col("_explicit"), "explicit_field").when(F.col("_asked").isNotNull(), "explicit_instruction").when(F.col("_kept").isNotNull(), "sticky").otherwise("script").alias("response_lang_source"),
    )
