"""Rows out of damaged model responses: JSON repair in tiers, salvage of turns, quiz rows and their grounding."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gates import valid_quiz
from ..functions.references import REFERENCE, _compared

# Code fences, junk after a closing quote, commas before a bracket, and the two orders of a turn's fields.
FENCE, STRAY, TRAILING = r"```(?:json)?", r'"[ \t]*[^\s",:}\]\[{]{1,3}[ \t]*(?=[,}\]\n])', r",(\s*[}\]])"
ROLE_FIRST = r'"role"\s*:\s*"(?:system|user|assistant)"\s*,\s*"content"\s*:\s*"(?:[^"\\]|\\.)*"'
CONTENT_FIRST = r'"content"\s*:\s*"(?:[^"\\]|\\.)*"\s*,\s*"role"\s*:\s*"(?:system|user|assistant)"'
ROLE_OF, CONTENT_OF = r'"role"\s*:\s*"(system|user|assistant)"', r'(?s)"content"\s*:\s*"((?:[^"\\]|\\.)*)"'
MIN_REQUEST = 15


def _closed(text: str) -> str:
    """text with what a cut left open closed: its string, then its containers, innermost first."""
    stack, quoted, at = [], False, 0
    while at < len(text):
        c = text[at]
        if quoted:
            if c == "\\":
                at += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack and stack[-1] == c:
            stack.pop()
        at += 1
    return re.sub(r",\s*$", "", text + '"' * quoted) + "".join(reversed(stack))


def _cut_back(text: str) -> str | None:
    """text up to its last closing bracket, with as many more as are missing."""
    last = max(text.rfind("}"), text.rfind("]"))
    if last < 0:
        return None
    part = text[: last + 1]
    return part + "}" * max(0, part.count("{") - part.count("}")) + "]" * max(0, part.count("[") - part.count("]"))


def _tiers(plain: str, fixed: str):
    yield "balanced", _closed(plain)
    yield "balanced_fixed", _closed(fixed)
    yield "cut_fixed", _cut_back(fixed)
    yield "cut", _cut_back(plain)


def _parses(text: str | None) -> bool:
    try:
        json.loads(text or "")
    except ValueError:
        return False
    return True


def recover_json(responses: DataFrame, id_col: str = "id", text_col: str = "response") -> DataFrame:
    """(id, json, tier) for each response: its JSON, repaired as little as will do, and by what; null where nothing helps.

    Fences and what stands before the first bracket go. Then: raw as it is, fixed (junk after strings, trailing commas),
    balanced and balanced_fixed (closed where it was cut), cut_fixed and cut (up to the last bracket). The first two are
    decided by Spark's parser and regexes; only what fails them goes to Python. Null and empty responses are rejects.
    """
    bare = F.btrim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), FENCE, ""), F.lit(" \t\n\x0b\f\r"))
    start = F.regexp_extract(bare, r"(?s)[{\[].*", 0)
    fixed = F.regexp_replace(F.regexp_replace("plain", STRAY, '"'), TRAILING, "$1")
    rows = responses.select(F.col(id_col), start.alias("plain")).withColumn("fixed", fixed)
    kind = rows.schema[0].dataType.simpleString()
    # within brackets nothing may follow the value, which Spark's parser would else pass over
    fine = lambda c: F.try_parse_json(F.concat(F.lit("["), F.col(c), F.lit("]"))).isNotNull() & (F.col(c) != "")
    sorted_ = rows.withColumn("tier", F.when(fine("plain"), "raw").when(fine("fixed"), "fixed"))
    easy = sorted_.where("tier IS NOT NULL").select(id_col, F.when(F.col("tier") == "raw", F.col("plain")).otherwise(F.col("fixed")).alias("json"), "tier")

    def repair(batches):
        for b in batches:
            got = [next(((t, name) for name, t in _tiers(p, f) if _parses(t)), (None, None)) if p else (None, None) for p, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [id_col, "json", "tier"])

    return easy.union(sorted_.where("tier IS NULL").select(id_col, "plain", "fixed").mapInArrow(repair, f"`{id_col}` {kind}, json string, tier string"))


def salvage(rejects: DataFrame, id_col: str = "id", text_col: str = "response") -> DataFrame:
    """(id, conversation, messages): the turns that can still be read, one row for each "messages" block that has any.

    Role before content is looked for first, the other order only in a block without it; JSON escapes are resolved where
    they are valid. Nulls, empty texts and texts without turns give no row.
    """
    bare = F.btrim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), FENCE, ""), F.lit(" \t\n\x0b\f\r"))
    parts = F.split(bare, r'"messages"\s*:')
    blocks = rejects.select(F.col(id_col), F.posexplode(F.when(F.size(parts) > 1, F.slice(parts, 2, 1 << 30)).otherwise(parts)).alias("conversation", "block"))
    spans = lambda p: F.regexp_extract_all("block", F.lit("(?s)" + p), F.lit(0))
    found = F.when(F.size(spans(ROLE_FIRST)) > 0, spans(ROLE_FIRST)).otherwise(spans(CONTENT_FIRST))

    def turn(span):
        raw = F.regexp_extract(span, CONTENT_OF, 1)
        read = F.from_json(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "v string")["v"]
        return F.struct(F.regexp_extract(span, ROLE_OF, 1).alias("role"), F.coalesce(read, raw).alias("content"))

    return blocks.select(id_col, "conversation", F.transform(found, turn).alias("messages")).where(F.size("messages") > 0)


def ungrounded_question(q: Column, context: Column) -> Column:
    """References in a question, its explanation and its right option that the context does not have."""
    said = F.array_join(F.array(F.coalesce(q["question"], F.lit("")), F.coalesce(q["explanation"], F.lit("")), F.coalesce(F.when(q["answer"] >= 0, F.get(q["options"], q["answer"])), F.lit(""))), " ")
    spans = F.transform(F.regexp_extract_all(said, F.lit(REFERENCE), F.lit(0)), lambda r: F.btrim(F.regexp_replace(r, r"(?U)\s+", " ")))
    haystack = _compared(F.coalesce(context, F.lit("")), True)
    return F.filter(spans, lambda r: (_compared(r, True) != "") & (F.instr(haystack, _compared(r, True)) == 0))


def judge_questions(quizzes: DataFrame, id_col: str = "quiz_id") -> DataFrame:
    """(id, place, q, reason, offenders) for each question of quizzes (id, questions, context): reason is invalid_structure,
    ungrounded_reference (with its offenders), repeated (its text, case and outer blanks aside, was kept before in the
    quiz) or null where it is kept."""
    each = quizzes.select(F.col(id_col), "context", F.posexplode("questions").alias("place", "q"))
    judged = each.withColumn("offenders", ungrounded_question(F.col("q"), F.col("context"))).withColumn("reason", F.when(~valid_quiz(F.col("q")), "invalid_structure").when(F.size("offenders") > 0, "ungrounded_reference"))
    again = F.row_number().over(Window.partitionBy(id_col, F.lower(F.trim("q.question")), F.col("reason").isNull()).orderBy("place"))
    judged = judged.withColumn("_nth", again)
    return judged.select(id_col, "place", "q", F.when(F.col("reason").isNull() & (F.col("_nth") > 1), "repeated").otherwise(F.col("reason")).alias("reason"), F.when(F.col("reason") == "ungrounded_reference", F.col("offenders")).alias("offenders"))


def quiz_rows(quizzes: DataFrame, fallbacks: list[str], id_col: str = "quiz_id", seed: int = 42) -> DataFrame:
    """(id, messages) of quizzes (id, request, questions): the valid questions as JSON after the request. Quizzes without
    a valid question give no row; a request under MIN_REQUEST characters is replaced from fallbacks by the id's md5."""
    valid = F.transform(F.filter("questions", valid_quiz), lambda q: F.struct(F.trim(q["question"]).alias("question"), F.transform(q["options"], F.trim).alias("options"), q["answer"].alias("answer"), F.trim(q["explanation"]).alias("explanation")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("long") % len(fallbacks)
    asked = F.trim(F.coalesce(F.col("request"), F.lit("")))
    request = F.when(F.length(asked) >= MIN_REQUEST, asked).otherwise(F.get(F.array(*map(F.lit, fallbacks)), draw.cast("int")))
    rows = quizzes.withColumn("_v", valid).where(F.size("_v") > 0)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select(id_col, F.array(turn("user", request), turn("assistant", F.to_json(F.struct(F.col("_v").alias("questions"))))).alias("messages"))
