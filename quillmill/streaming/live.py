"""A session turn by turn: its numbering, its languages and its segment from one keyed state, and the same in batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.language import detect_lang_instruction, detect_query_lang, is_anaphoric
from ..operators.conversation import append_exchanges, resolve_languages
from ..sources.tables import upsert
from .sessions import resolve_segments, segment_step

GIVEN = ["requested_domain", "routed_domain", "routed_source", "corpus_version", "probe_context", "probe_sources"]
RESULT = "event string, user_turn long, assistant_turn long, question string, answer string, query_lang string, response_lang string, response_lang_source string, context string, sources array<string>, segment_id long, is_new_pin boolean, domain string, domain_source string"
NAMES = [part.split()[0] for part in RESULT.split(", ")]


def language_step(held: tuple[str | None, str | None], own: str, asked: str | None, explicit: str | None) -> tuple[tuple[str, str, str], tuple[str | None, str | None]]:
    """((query_lang, response_lang, source), the override after the turn and the language it was set in)."""
    if explicit is not None:
        return (explicit, explicit, "explicit_field"), (None, None)
    if asked is not None:
        return (own, asked, "explicit_instruction"), (asked, own)
    if held[0] is not None and held[1] == own:
        return (own, held[0], "sticky"), held
    return (own, own, "script"), (None, None)


class _Session(StatefulProcessor):
    """State of a session: the pin, the language override, the last turn and segment, the time of the last exchange.

    A timer ends what an idle session holds; its numbers stay, so that a later visit goes on from them. Whether a visit has
    ended is decided by the times of the exchanges, so results do not depend on when the timer comes.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pin = handle.getValueState("pin", "pin string")
        self.language = handle.getValueState("language", "override string, query_lang string")
        self.numbers = handle.getValueState("numbers", "turn_index long, segment_id long")
        self.last = handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pin = json.loads(self.pin.get()[0]) if self.pin.exists() else None
        held = tuple(self.language.get()) if self.language.exists() else (None, None)
        turn, segment = (int(x) for x in self.numbers.get()) if self.numbers.exists() else (0, 0)
        last = int(self.last.get()[0]) if self.last.exists() else None
        given = pd.concat(list(rows)).sort_values("ord").astype(object)
        out = []
        for r in given.where(given.notna(), None).to_dict("records"):
            if last is not None and r["at_ms"] - last > self.idle_ms:
                pin, held = None, (None, None)
            said, held = language_step(held, r["own_lang"], r["asked"], r["explicit_language"])
            got, pin = segment_step(pin, r | {"query_lang": said[0]}, segment)
            segment, last = max(segment, got[2]), r["at_ms"]
            out.append((key[0], int(r["ord"]), int(r["at_ms"]), "turn", turn + 1, turn + 2, r["question"], r["answer"], *said, got[0], list(got[1]), *got[2:]))
            turn += 2
        self.pin.update((json.dumps(pin),))
        self.language.update(held)
        self.numbers.update((turn, segment))
        self.last.update((last,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=["session_id", "ord", "at_ms", *NAMES])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, segment = self.numbers.get()
        last = self.last.get()[0]
        self.pin.clear()
        self.language.clear()
        yield pd.DataFrame([(key[0], None, int(last), "closed", None, int(turn), None, None, None, None, None, None, None, int(segment), None, None, None)], columns=["session_id", "ord", "at_ms", *NAMES]).astype(object)

    def close(self) -> None:
        pass


def _prepared(exchanges: DataFrame) -> DataFrame:
    text = F.col("question")
    return exchanges.withColumns({"own_lang": detect_query_lang(text), "asked": detect_lang_instruction(text), "anaphoric": is_anaphoric(text), "at_ms": F.unix_millis(F.col("at").cast("timestamp"))})


def session_stream(exchanges: DataFrame, idle_seconds: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """(session_id, ord, at_ms, event, turns, question, answer, languages, segment …) of arriving exchanges.

    exchanges: (session_id, ord, at, question, answer, explicit_language, requested_domain, routed_domain, routed_source,
    corpus_version, probe_context, probe_sources); `ord` rises in a session. Each gives a row of event 'turn': its two
    turn numbers, the languages it is searched and answered in, and the segment it answers from. A session idle for
    idle_seconds of event time gives one 'closed' row and forgets its pin and override. RocksDB state store.
    """
    rows = _prepared(exchanges.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay))
    kind = rows.schema["session_id"].dataType.simpleString()
    kept = rows.select("session_id", "ord", "at", "at_ms", "question", "answer", "explicit_language", "own_lang", "asked", "anaphoric", *GIVEN)
    return kept.groupBy("session_id").transformWithStateInPandas(_Session(idle_seconds * 1000), f"session_id {kind}, ord long, at_ms long, {RESULT}", "Append", "EventTime")


def replay_sessions(exchanges: DataFrame, idle_seconds: int = 1800) -> DataFrame:
    """The 'turn' rows of session_stream() for a whole table, from the batch operators: numbering over the session, languages
    and segments over each visit (exchanges no further than idle_seconds apart)."""
    order = Window.partitionBy("session_id").orderBy("ord")
    rows = _prepared(exchanges)
    gap = F.coalesce(F.col("at_ms") - F.lag("at_ms").over(order) > idle_seconds * 1000, F.lit(False))
    rows = rows.withColumn("visit", F.sum(gap.cast("int")).over(order))
    visit = F.struct(F.col("session_id").alias("s"), F.col("visit").alias("v"))
    turns = rows.select(visit.alias("session_id"), F.col("ord").alias("turn_index"), F.lit("user").alias("role"), F.col("question").alias("content"), "explicit_language", *GIVEN)
    languages = resolve_languages(turns)
    segments = resolve_segments(turns.join(languages.select("session_id", "turn_index", "query_lang"), ["session_id", "turn_index"]))
    none = rows.select("session_id", F.lit(0).alias("turn_index")).where("false")
    numbered = append_exchanges(none, rows.select("session_id", "ord", F.col("ord").alias("question"), F.col("ord").alias("answer"))).where("role = 'user'")
    # segments go on from visit to visit
    ends = segments.groupBy(F.col("session_id.s").alias("s"), F.col("session_id.v").alias("v")).agg(F.max("segment_id").alias("n"))
    before = ends.select("s", "v", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    said = languages.join(segments, ["session_id", "turn_index"]).select(F.col("session_id.s").alias("s"), F.col("session_id.v").alias("v"), F.col("turn_index").alias("ord"), "query_lang", "response_lang", "response_lang_source", "context", "sources", "segment_id", "is_new_pin", "domain", "domain_source")
    said = said.join(before, ["s", "v"]).withColumn("segment_id", F.col("segment_id") + F.col("shift"))
    out = rows.join(numbered.select("session_id", F.col("turn_index").alias("user_turn"), F.col("content").alias("ord")), ["session_id", "ord"])
    out = out.select(F.col("session_id").alias("s"), "ord", "at_ms", "user_turn", "question", "answer").join(said, ["s", "ord"])
    return out.withColumns({"session_id": F.col("s"), "event": F.lit("turn"), "user_turn": F.col("user_turn").cast("long"), "assistant_turn": (F.col("user_turn") + 1).cast("long")}).select("session_id", "ord", "at_ms", *NAMES)


def session_rows(events: DataFrame) -> DataFrame:
    """(session_id, turn, domain, language, segment_id, override, override_lang, opened_ms) of 'turn' rows: what a session's row
    holds after each of them. An override is stored while the answers follow an instruction."""
    kept = F.col("response_lang_source").isin("explicit_instruction", "sticky")
    return events.where("event = 'turn'").select("session_id", F.col("assistant_turn").alias("turn"), "domain", F.col("query_lang").alias("language"), "segment_id", F.when(kept, F.col("response_lang")).alias("override"), F.when(kept, F.col("query_lang")).alias("override_lang"), F.col("at_ms").alias("opened_ms"))


def store_sessions(events: DataFrame, batch_id: int, table: str) -> None:
    """One trigger's events into table/messages (two rows an exchange, a folder a batch that a repeat replaces) and
    table/sessions (one row a session: its last exchange's values, and when it was opened)."""
    turns = events.where("event = 'turn'")
    pair = F.array(F.struct(F.col("user_turn").alias("turn_index"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.col("assistant_turn").alias("turn_index"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    said = turns.select("session_id", "segment_id", "domain", F.col("query_lang").alias("language"), F.explode(pair).alias("m")).select("session_id", "m.*", "segment_id", "domain", "language", F.lit(batch_id).alias("batch"))
    said.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{table}/messages")
    upsert(f"{table}/sessions", session_rows(events), ["session_id"], "turn", first=["opened_ms"])


def write_sessions(stream: DataFrame, table: str, checkpoint: str):
    """Start session_stream() into store_sessions(); replayed triggers change nothing."""

    def put(events: DataFrame, batch: int) -> None:
        events.persist()  # both tables come from one run of the state
        try:
            store_sessions(events, batch, table)
        finally:
            events.unpersist()

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
