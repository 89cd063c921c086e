"""Sessions turn by turn: which context a turn answers from, and speech endpoints; the same step for batch and stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.language import is_anaphoric

TURN = ["turn_index", "anaphoric", "query_lang", "requested_domain", "routed_domain", "routed_source", "corpus_version", "probe_context", "probe_sources"]
SEGMENT = "session_id {kind}, turn_index long, context string, sources array<string>, segment_id long, is_new_pin boolean, domain string, domain_source string"


def segment_step(pin: dict | None, turn: dict, last: int = 0) -> tuple[tuple, dict | None]:
    """((context, sources, segment_id, is_new_pin, domain, domain_source), the pin after the turn); last is the segment
    before, where there is no pin.

    A follow-up without a topic of its own keeps the pin as long as language, domain and corpus agree. Any other turn is
    judged by what its own retrieval found: in another scope it starts a segment, unless it found nothing and there is a
    pin to fall back on; in the pin's scope it keeps the pin if the sources overlap or nothing was found.
    """
    requested, version = turn["requested_domain"], turn["corpus_version"]
    current = pin is not None and pin["language"] == turn["query_lang"] and (version is None or pin["corpus_version"] == version)
    if current and turn["anaphoric"] and requested in (None, pin["domain"]):
        return (pin["context"], pin["sources"], pin["segment_id"], False, pin["domain"], "page_context" if requested is not None else "pinned"), pin
    domain, source = (requested, "page_context") if requested is not None else (turn["routed_domain"], turn["routed_source"])
    found, sources = turn["probe_context"] or "", list(turn["probe_sources"] if turn["probe_sources"] is not None else [])
    if current and pin["domain"] == domain:
        if set(sources) & set(pin["sources"]) or not found.strip():
            return (pin["context"], pin["sources"], pin["segment_id"], False, domain, source), pin
    elif pin is not None and not found.strip() and pin["context"].strip():
        return (pin["context"], pin["sources"], pin["segment_id"], False, pin["domain"], "pinned"), pin
    new = {"context": found, "sources": sources, "segment_id": (pin["segment_id"] if pin else last) + 1, "domain": domain, "language": turn["query_lang"], "corpus_version": version}
    return (found, sources, new["segment_id"], True, domain, source), new


def _turns(turns: DataFrame) -> DataFrame:
    """User turns with what the step needs; the probe is the turn's own retrieval (it is condensed only where the step
    would not look at it)."""
    return turns.withColumn("anaphoric", is_anaphoric(F.col("content"))).select("session_id", *TURN)


def resolve_segments(turns: DataFrame) -> DataFrame:
    """(session_id, turn_index, context, sources, segment_id, is_new_pin, domain, domain_source) for user turns (session_id,
    turn_index, content, query_lang, requested_domain, routed_domain, routed_source, corpus_version, probe_context,
    probe_sources). Retrieval and routing of all turns come in as columns; the sessions are streamed in order, and a task
    holds one session's pin at a time."""
    rows = _turns(turns)
    kind = rows.schema["session_id"].dataType.simpleString()

    def run(batches):
        session, pin, first = None, None, True
        for b in batches:
            out = []
            for r in b.to_pylist():
                if first or r["session_id"] != session:
                    session, pin, first = r["session_id"], None, False
                got, pin = segment_step(pin, r)
                out.append((session, r["turn_index"], *got))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((b.column(0).type, pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.string(), pa.string()))], _NAMES)

    return rows.repartition("session_id").sortWithinPartitions("session_id", "turn_index").mapInArrow(run, SEGMENT.format(kind=kind))


_NAMES = ["session_id", "turn_index", "context", "sources", "segment_id", "is_new_pin", "domain", "domain_source"]


class _Segments(StatefulProcessor):
    """The pin of a session, as JSON; it ends when the session has been idle for the time to live."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pin = handle.getValueState("pin", "pin string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.pin.get() if self.pin.exists() else None
        pin, out = json.loads(kept[0]) if kept else None, []
        turns = pd.concat(list(rows)).sort_values("turn_index").astype(object)
        for r in turns.where(turns.notna(), None).to_dict("records"):
            got, pin = segment_step(pin, r)
            out.append((key[0], int(r["turn_index"]), *got))
        self.pin.update((json.dumps(pin),))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def resolve_segments_stream(turns: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """resolve_segments() of arriving turns (the RocksDB state store): turns of one trigger are taken in order, later ones
    go on from the session's pin."""
    rows = _turns(turns)
    kind = rows.schema["session_id"].dataType.simpleString()
    return rows.groupBy("session_id").transformWithStateInPandas(_Segments(ttl_ms), SEGMENT.format(kind=kind), "Append", "None" if ttl_ms is None else "ProcessingTime")


def endpoint_step(state: tuple[int, int, bool], loud: bool, min_loud: int, min_quiet: int) -> tuple[tuple[int, int, bool], str | None]:
    """((loud run, quiet run, in speech), event) after one frame."""
    up, down, speaking = (state[0] + 1, 0, state[2]) if loud else (0, state[1] + 1, state[2])
    if not speaking and up >= min_loud:
        return (up, down, True), "speech_start"
    if speaking and down >= min_quiet:
        return (up, down, False), "speech_end"
    return (up, down, speaking), None


class _Endpoints(StatefulProcessor):
    def __init__(self, threshold: float, min_loud: int, min_quiet: int):
        self.limits = threshold, min_loud, min_quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", "up long, down long, speaking boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        threshold, min_loud, min_quiet = self.limits
        state, out = tuple(self.runs.get()) if self.runs.exists() else (0, 0, False), []
        frames = pd.concat(list(rows)).sort_values("frame_no")
        for frame, level in zip(frames["frame_no"], frames["level"], strict=True):
            state, event = endpoint_step(state, bool(level is not None and level >= threshold), min_loud, min_quiet)
            if event:
                out.append((key[0], int(frame), event))
        self.runs.update((int(state[0]), int(state[1]), bool(state[2])))
        yield pd.DataFrame(out, columns=["stream_id", "frame_no", "event"])

    def close(self) -> None:
        pass


def endpoints_stream(frames: DataFrame, threshold: float, min_loud: int = 10, min_quiet: int = 20) -> DataFrame:
    """evaluation.endpoints() of arriving frames (stream_id, frame_no, level): runs go on from trigger to trigger."""
    kind = frames.schema["stream_id"].dataType.simpleString()
    rows = frames.select("stream_id", "frame_no", F.col("level").cast("double").alias("level"))
    return rows.groupBy("stream_id").transformWithStateInPandas(_Endpoints(threshold, min_loud, min_quiet), f"stream_id {kind}, frame_no long, event string", "Append", "None")
