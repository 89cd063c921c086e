"""Registered queries over sessions as they arrive: segments, live sessions, session rows, seeded dedup, progress alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources.tables import read_keyed, upsert
from ..streaming import live as Z
from ..streaming import progress as B
from ..streaming.sessions import resolve_segments
from . import registered_text as text
from .catalogue import ORACLES, query, table
from .registered_citing import _segment_turns

# one step of a session for each round: whether the pin is current (cur), what is done with it (act), what comes out
_STEP = """CASE WHEN cur AND anaphoric AND (requested_domain IS NULL OR requested_domain = pd) THEN 'hold' WHEN cur AND pd = dom THEN CASE WHEN list_has_any(probe_sources, ps) OR trim(probe_context) = '' THEN 'keep' ELSE 'new' END
WHEN NOT fresh AND trim(probe_context) = '' AND trim(pc) <> '' THEN 'fall' ELSE 'new' END"""


def _segments_sql(turns: str, more: str = "") -> str:
    """Recursion over t: the turns of a session in order (p), with what the pin was before each."""
    first = "NULL::VARCHAR AS pc, NULL::VARCHAR[] AS ps, 0::BIGINT AS pseg, NULL::VARCHAR AS pd, NULL::VARCHAR AS pl, NULL::VARCHAR AS pv"
    new = lambda a, b: f"CASE WHEN act = 'new' THEN {a} ELSE {b} END"
    after = f"{new('probe_context', 'pc')} AS pc, {new('probe_sources', 'ps')} AS ps, {new('pseg + 1', 'pseg')} AS pseg, {new('dom', 'pd')} AS pd, {new('query_lang', 'pl')} AS pl, {new('corpus_version', 'pv')} AS pv"
    given = lambda s: f"SELECT *, {_STEP} AS act FROM (SELECT *, NOT fresh AND pl = query_lang AND (corpus_version IS NULL OR pv IS NOT DISTINCT FROM corpus_version) AS cur FROM ({s}))"
    start = given(f"SELECT t.*, {first} FROM t WHERE p = 1")
    rest = given("SELECT t.*, s.a_pc AS pc, s.a_ps AS ps, s.a_pseg AS pseg, s.a_pd AS pd, s.a_pl AS pl, s.a_pv AS pv FROM s JOIN t ON t.session_id = s.session_id AND t.p = s.p + 1")
    step = lambda s: f"SELECT session_id, p, act, pc AS b_pc, ps AS b_ps, pd AS b_pd, {after.replace(' AS ', ' AS a_')} FROM ({s})"
    return f"""WITH RECURSIVE t AS (SELECT *, coalesce(requested_domain, routed_domain) AS dom, CASE WHEN requested_domain IS NULL THEN routed_source ELSE 'page_context' END AS src FROM ({turns})){more},
s AS ({step(start)} UNION ALL {step(rest)}),
e AS (SELECT t.*, s.act, CASE WHEN act = 'new' THEN probe_context ELSE b_pc END AS context, array_to_string(CASE WHEN act = 'new' THEN probe_sources ELSE b_ps END, '|') AS sources, a_pseg AS segment_id, act = 'new' AS is_new_pin,
CASE WHEN act IN ('hold', 'fall') THEN b_pd ELSE dom END AS domain, CASE act WHEN 'hold' THEN CASE WHEN requested_domain IS NULL THEN 'pinned' ELSE 'page_context' END WHEN 'fall' THEN 'pinned' ELSE src END AS domain_source FROM s JOIN t ON s.session_id = t.session_id AND s.p = t.p)"""


_PLACE = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p"
_E5 = f"""SELECT session_id, p, turn_index, {text._ANA} AS anaphoric, query_lang, requested_domain, routed_domain, 'retrieval' AS routed_source, corpus_version, probe_context, probe_sources, p = 1 AS fresh FROM (
SELECT conv_id AS session_id, {_PLACE}, turn AS turn_index, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'et pourquoi ?' ELSE coalesce(text, '') END AS text, CASE WHEN conv_id % 7 = turn THEN 'darija' ELSE 'fr' END AS query_lang, CASE WHEN conv_id % 5 = turn THEN 'law' END AS requested_domain, CASE WHEN turn % 4 < 2 THEN 'law' ELSE 'tax' END AS routed_domain,
concat('v', turn // 6) AS corpus_version, CASE WHEN conv_id % 4 <> turn % 4 THEN concat('about ', substr(text, 1, 20)) ELSE '' END AS probe_context, [concat('s', turn % 5), concat('s', conv_id % 5)] AS probe_sources FROM conversations WHERE role = 'user')"""


@query("e5_segments", _segments_sql(_E5) + " SELECT session_id, turn_index, context, sources, segment_id, is_new_pin, domain, domain_source FROM e")
def e5(spark, sf):
    return resolve_segments(_segment_turns(spark, sf)).withColumn("sources", F.array_join("sources", "|"))


# exchanges with two visits in every third session, follow-ups, instructions, requested domains, empty probes, a new corpus
_GIVEN = {
    "explicit_language": "CASE WHEN conv_id % 7 = 3 AND turn % 6 = 2 THEN 'fr' END", "requested_domain": "CASE WHEN conv_id % 5 = 4 AND turn % 6 = 4 THEN 'law' END", "routed_domain": "CASE WHEN (conv_id + turn) % 9 < 7 THEN 'law' ELSE 'tax' END", "routed_source": "'retrieval'",
    "corpus_version": "CASE WHEN conv_id % 11 > 0 THEN concat('v', CAST(floor(turn / 8) AS INT)) END", "probe_context": "CASE WHEN conv_id % 4 <> turn % 4 THEN concat('about ', substr(text, 1, 20)) ELSE '' END",
}
_AT = "turn * 60 + CASE WHEN conv_id % 3 = 0 AND turn >= 4 THEN 7200 ELSE 0 END"


def _exchanges(spark, sf):
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = text._planted(spark, sf).withColumn("answer", F.when(F.lead("role").over(order) == "assistant", F.lead("text").over(order))).where("role = 'user'")
    sources = F.array(F.concat(F.lit("s"), (F.col("turn") % 5).cast("string")), F.concat(F.lit("s"), (F.col("conv_id") % 5).cast("string")))
    return said.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("ord"), F.timestamp_seconds(F.lit(1_700_000_000) + F.expr(_AT)).alias("at"), F.coalesce("text", F.lit("")).alias("question"), "answer", *[F.expr(e).alias(c) for c, e in _GIVEN.items()], sources.alias("probe_sources"))


_L4 = f"""SELECT session_id, p, turn_index, text, {text._ANA} AS anaphoric, coalesce(explicit_language, own) AS query_lang, own, asked, explicit_language, requested_domain, routed_domain, routed_source, corpus_version, probe_context, probe_sources, at_s, coalesce(at_s - lag(at_s) OVER (PARTITION BY session_id ORDER BY p) > 1800, true) AS fresh FROM (
SELECT c.conv_id AS session_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS p, c.turn AS turn_index, text, lang AS own, asked, {_AT.replace("turn", "c.turn")} AS at_s, {", ".join(f"{e.replace('turn', 'c.turn')} AS {c}" for c, e in _GIVEN.items())}, [concat('s', c.turn % 5), concat('s', conv_id % 5)] AS probe_sources
FROM (SELECT conv_id, turn, role, coalesce({text._PLANT}, '') AS text FROM conversations) c JOIN b ON b.row_id = c.conv_id AND b.turn = c.turn JOIN i ON i.row_id = c.conv_id AND i.turn = c.turn WHERE role = 'user')"""
_LANGUAGES = """, h AS (SELECT session_id, p, own, asked, explicit_language, NULL::VARCHAR AS held, NULL::VARCHAR AS held_lang, NULL::VARCHAR AS response_lang, NULL::VARCHAR AS source FROM t WHERE false
UNION ALL SELECT session_id, p, own, asked, explicit_language, CASE WHEN explicit_language IS NULL THEN asked END, CASE WHEN explicit_language IS NULL AND asked IS NOT NULL THEN own END, coalesce(explicit_language, asked, own), CASE WHEN explicit_language IS NOT NULL THEN 'explicit_field' WHEN asked IS NOT NULL THEN 'explicit_instruction' ELSE 'script' END FROM t WHERE p = 1
UNION ALL SELECT session_id, p, own, asked, explicit_language, CASE WHEN explicit_language IS NOT NULL THEN NULL WHEN asked IS NOT NULL THEN asked WHEN k THEN held END, CASE WHEN explicit_language IS NOT NULL THEN NULL WHEN asked IS NOT NULL THEN own WHEN k THEN held_lang END,
CASE WHEN explicit_language IS NOT NULL THEN explicit_language WHEN asked IS NOT NULL THEN asked WHEN k THEN held ELSE own END, CASE WHEN explicit_language IS NOT NULL THEN 'explicit_field' WHEN asked IS NOT NULL THEN 'explicit_instruction' WHEN k THEN 'sticky' ELSE 'script' END
FROM (SELECT t.session_id, t.p, t.own, t.asked, t.explicit_language, h.held, h.held_lang, NOT t.fresh AND h.held IS NOT NULL AND h.held_lang = t.own AS k FROM h JOIN t ON t.session_id = h.session_id AND t.p = h.p + 1))"""
_LIVE = _segments_sql(_L4, _LANGUAGES).replace("WITH RECURSIVE t AS", f"WITH RECURSIVE b AS ({ORACLES['b4_query_language']}), i AS ({ORACLES['b5_language_instruction']}), t AS")
_LIVE_ROWS = "SELECT e.session_id, e.turn_index AS ord, 2 * e.p - 1 AS user_turn, e.query_lang, h.response_lang, h.source AS response_lang_source, e.context, e.sources, e.segment_id, e.is_new_pin, e.domain, e.domain_source FROM e JOIN h ON e.session_id = h.session_id AND e.p = h.p"


def drain(stream, path: str):
    """Run a stream over all its input into Parquet below path, and read what it wrote."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("l4_session_stream", _LIVE + _LIVE_ROWS)
def l4(spark, sf):
    path, rows = S.scratch_path(spark, "live"), _exchanges(spark, sf)
    rows = S.settle(rows, "exchanges")
    cuts = ["unix_timestamp(at) < 1700000240", "unix_timestamp(at) >= 1700000240 AND unix_timestamp(at) < 1700003600", "unix_timestamp(at) >= 1700003600"]
    for cut in cuts[:-1]:
        rows.where(cut).write.mode("append").parquet(f"{path}/in")
        drain(Z.session_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), path)
    rows.where(cuts[-1]).write.mode("append").parquet(f"{path}/in")
    done = drain(Z.session_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), path)  # each run goes on from the last one's state
    return done.where("event = 'turn'").select("session_id", "ord", "user_turn", "query_lang", "response_lang", "response_lang_source", "context", F.array_join("sources", "|").alias("sources"), "segment_id", "is_new_pin", "domain", "domain_source")


@query("l4_session_replay", _LIVE + _LIVE_ROWS)
def l4_replay(spark, sf):
    done = Z.replay_sessions(_exchanges(spark, sf))
    return done.select("session_id", "ord", "user_turn", "query_lang", "response_lang", "response_lang_source", "context", F.array_join("sources", "|").alias("sources"), "segment_id", "is_new_pin", "domain", "domain_source")


_LAST = "SELECT e.session_id, 2 * e.p AS turn, e.domain, e.query_lang AS language, e.segment_id, CASE WHEN h.source IN ('explicit_instruction', 'sticky') THEN h.response_lang END AS override, CASE WHEN h.source IN ('explicit_instruction', 'sticky') THEN e.query_lang END AS override_lang, (SELECT (1700000000 + o.at_s) * 1000 FROM t o WHERE o.session_id = e.session_id AND o.p = 1) AS opened_ms FROM e JOIN h ON e.session_id = h.session_id AND e.p = h.p WHERE e.p = (SELECT max(p) FROM t o WHERE o.session_id = e.session_id)"


@query("e3_session_rows", _LIVE + _LAST)
def e3_sessions(spark, sf):
    events, path = S.settle(Z.replay_sessions(_exchanges(spark, sf)), "events"), S.scratch_path(spark, "sessions")
    for part in ("ord < 2", "ord >= 2 AND ord < 4", "ord < 2", "ord >= 4", "ord >= 2 AND ord < 4"):  # late and repeated parts change nothing
        upsert(path, Z.session_rows(events.where(part)), ["session_id"], "turn", first=["opened_ms"])
    return read_keyed(spark, path)


_KEYED = "SELECT event_id, ts, concat(event_type, '-', CAST(user_id % 97 AS VARCHAR)) AS key FROM events"


@query("l5_seeded_dedup", f"WITH k AS ({_KEYED}) SELECT key, min(ts) AS ts FROM k WHERE event_id % 5 > 0 AND key NOT IN (SELECT key FROM k WHERE event_id % 5 = 0 AND event_id % 3 = 0) GROUP BY key")
def l5(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.concat("event_type", F.lit("-"), (F.col("user_id") % 97).cast("string")).alias("key"))
    path, seen = S.scratch_path(spark, "arrived"), e.where("event_id % 5 = 0 AND event_id % 3 = 0")
    days = F.ntile(4).over(Window.partitionBy(F.lit(0)).orderBy("day"))
    parts = e.select(F.to_date("ts").alias("day")).distinct().withColumn("part", days)  # one row a day
    S.settle(e.where("event_id % 5 > 0").withColumn("day", F.to_date("ts")).join(F.broadcast(parts), "day"), "parts").drop("day").write.partitionBy("part").parquet(path)
    for part in range(1, 5):  # the days arrive in order, a run each, from the same state
        arrived = spark.readStream.schema(e.schema).parquet(f"{path}/part={{{','.join(str(p) for p in range(1, part + 1))}}}")
        done = drain(B.dedup_stream_seeded(arrived, seen, "key"), path + "-run")
    return done.select("key", "ts")
