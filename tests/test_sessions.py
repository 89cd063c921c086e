"""Sessions, seeded dedup and progress alerts as streams against their batch forms; keyed tables written in part."""

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def exchanges(spark):
    from quillmill.plans.registered_sessions import _exchanges

    return _exchanges(spark, "/root/testdata/sf0.001")


def fields(rows):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows)


def test_live_sessions_close_and_fill_tables(spark, tmp_path):
    """Runs that start again from the checkpoint, closed sessions, messages and session rows, a trigger that comes twice."""
    from quillmill.sources.tables import read_keyed
    from quillmill.streaming import live

    rows, table = exchanges(spark), str(tmp_path / "table")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ("unix_timestamp(at) < 1700000240", "unix_timestamp(at) >= 1700000240"):
            rows.where(part).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
            stream = live.session_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), delay="1 second")
            live.write_sessions(stream, table, str(tmp_path / "ck")).awaitTermination()
    finally:
        spark.conf.unset(provider)
    want = live.replay_sessions(rows)
    kept = ["session_id", "turn", "domain", "language", "segment_id", "override", "override_lang"]
    last = {}
    for r in sorted(live.session_rows(want).collect(), key=lambda r: r.turn):
        last[r.session_id] = tuple(r[c] for c in kept)
    assert fields(read_keyed(spark, f"{table}/sessions").select(kept).collect()) == sorted(last.values())
    said = spark.read.parquet(f"{table}/messages")
    assert said.count() == 2 * want.count()
    assert fields(said.where("role = 'user'").select("session_id", "turn_index", "content", "segment_id").collect()) == fields(want.select("session_id", "user_turn", "question", "segment_id").collect())
    assert said.where("role = 'assistant' AND turn_index % 2 = 1").count() == 0
    again = want.where("ord < 2")
    live.store_sessions(again, 77, table)
    live.store_sessions(again, 77, table)
    assert fields(read_keyed(spark, f"{table}/sessions").select(kept).collect()) == sorted(last.values())
    assert spark.read.parquet(f"{table}/messages").count() == said.count() + 2 * again.count()


def test_live_sessions_forget_what_is_idle(spark, tmp_path):
    from quillmill.plans.registered_sessions import drain
    from quillmill.streaming import live

    def row(session, ord_, minute, question="quelle est la règle sur les congés payés", probe="A", source="s"):
        return (session, ord_, START + timedelta(minutes=minute), question, "ok", None, None, "law", "retrieval", "v", probe, [source])

    schema = "session_id long, ord long, at timestamp, question string, answer string, explicit_language string, requested_domain string, routed_domain string, routed_source string, corpus_version string, probe_context string, probe_sources array<string>"
    rows = [row(1, 1, 0), row(1, 2, 1, "pourquoi ?", "B"), row(1, 3, 2, probe="C", source="t"), row(1, 4, 60, "pourquoi ?", "D"), row(2, 1, 55), row(3, 1, 70)]
    frame = spark.createDataFrame(rows, schema)
    for part in ("ord < 3 AND session_id = 1", "ord = 3", "ord > 3 OR session_id > 1"):
        frame.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done = drain(live.session_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 1800, "0 seconds"), str(tmp_path / "run"))
    turns = done.where("event = 'turn'").select("session_id", "ord", "user_turn", "context", "segment_id", "is_new_pin").collect()
    assert fields(turns) == [(1, 1, 1, "A", 1, True), (1, 2, 3, "A", 1, False), (1, 3, 5, "C", 2, True), (1, 4, 7, "D", 3, True), (2, 1, 1, "A", 1, True), (3, 1, 1, "A", 1, True)]
    assert fields(turns) == fields(live.replay_sessions(frame).select("session_id", "ord", "user_turn", "context", "segment_id", "is_new_pin").collect())
    # nobody is idle for over half an hour when the newest exchange came, but the first visit of session 1 was
    assert fields(done.where("event = 'closed'").select("session_id", "assistant_turn", "segment_id").collect()) in ([], [(1, 6, 2)])
    late = spark.createDataFrame([row(4, 1, 200)], schema)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    done = drain(live.session_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 1800, "0 seconds"), str(tmp_path / "run"))
    closed = fields(done.where("event = 'closed'").select("session_id", "assistant_turn", "segment_id").collect())
    assert {(1, 8, 3), (2, 2, 1), (3, 2, 1)} <= set(closed)


def test_upsert_replaces_only_what_it_touches(spark, tmp_path):
    import glob
    import os

    from quillmill.sources.tables import read_keyed, upsert

    path = str(tmp_path / "table")
    assert read_keyed(spark, path) is None
    make = lambda rows: spark.createDataFrame(rows, "k string, v long, note string, born long")
    upsert(path, make([(f"k{i}", 1, "a", 10) for i in range(200)] + [(None, 1, "n", 1)] * 3), ["k"], "v", first=["born"])
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    before = files()
    upsert(path, make([("k7", 3, "c", 30), ("k7", 2, "b", 20), ("new", 1, None, None), ("k9", 0, "old", 5)]), ["k"], "v", first=["born"])
    after = files()
    assert 0 < len(before.keys() - after.keys()) <= 3  # at most the buckets of the three keys
    got = {r.k: (r.v, r.note, r.born) for r in read_keyed(spark, path).collect()}
    assert len(got) == 202 == read_keyed(spark, path).count() and got["k7"] == (3, "c", 10) and got["new"] == (1, None, None) and got["k9"] == (1, "a", 5) and got["k8"] == (1, "a", 10) and got[None] == (1, "n", 1)
    upsert(path, make([("k7", 2, "b", 20)]), ["k"], "v", first=["born"])
    assert {r.k: (r.v, r.note, r.born) for r in read_keyed(spark, path).collect()} == got
    upsert(path, make([]), ["k"], "v", first=["born"])
    assert read_keyed(spark, path).count() == 202


def test_seeded_dedup_stream(spark, tmp_path):
    from quillmill.plans.registered_sessions import drain
    from quillmill.streaming.progress import dedup_stream_seeded

    schema = "key string, ts timestamp, big long, note array<string>"
    at = lambda m: START + timedelta(minutes=m)
    first = [("a", at(3), 2**60 + 1, ["x"]), ("a", at(1), None, None), ("seeded", at(0), 1, []), (None, at(5), 1, None), (None, at(6), 2, None)]
    second = [("a", at(0), 9, None), ("b", None, 2**60 + 3, ["y"]), (None, at(0), 3, None)]
    seen = spark.createDataFrame([("seeded", 1), ("seeded", 2)], "key string, other int")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done = drain(dedup_stream_seeded(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), seen, "key"), str(tmp_path / "run"))
    got = {r.key: (r.big, r.note) for r in done.collect()}
    assert got == {"a": (None, None), None: (1, None), "b": (2**60 + 3, ["y"])} and done.count() == 3


def lines(spark):
    rows = []
    for c, last_row, last_try in (("runs", 95, 100), ("stalls", 20, 99), ("stops", 20, 30), ("done", 30, 40), ("rejects", None, 98)):
        rows += [(c, START + timedelta(minutes=m), last_row is not None and m <= last_row) for m in range(0, last_try + 1, 5)]
        rows += [(c, START + timedelta(minutes=last_try, seconds=7), False)]
    return spark.createDataFrame(rows, "component string, ts timestamp, accepted boolean"), spark.createDataFrame([("runs", 1000), ("stalls", 1000), ("stops", 1000), ("done", 5), ("rejects", 1), ("never", 3)], "component string, target int")


def test_progress_alerts_replayed(spark, tmp_path):
    """The state told last of each component is the board's, whatever the triggers; every change is told once."""
    from quillmill.plans.registered_sessions import drain
    from quillmill.streaming.progress import progress_alerts, progress_counts, progress_states

    attempts, targets = lines(spark)
    for lo, hi in ((0, 25), (25, 60), (60, 200)):
        attempts.where((F.col("ts") >= START + timedelta(minutes=lo)) & (F.col("ts") < START + timedelta(minutes=hi))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done = drain(progress_alerts(spark.readStream.schema(attempts.schema).parquet(str(tmp_path / "in")), targets, 1200, 300, "EventTime"), str(tmp_path / "run"))
    told = {}
    for r in sorted(done.collect(), key=lambda r: r.at_ms):
        told.setdefault(r.component, []).append(r.state)
    want = {r.component: r.state for r in progress_states(progress_counts(attempts.where("accepted")), progress_counts(attempts), targets).collect()}
    assert {c: s[-1] for c, s in told.items()} == want
    assert want == {"runs": "running", "stalls": "nothing_accepted", "stops": "no_attempts", "done": "target met", "rejects": "nothing_accepted", "never": "no_attempts"}
    assert all(a != b for s in told.values() for a, b in zip(s, s[1:], strict=False)) and told["stalls"][-2:] == ["running", "nothing_accepted"]


def test_progress_alerts_without_new_lines(spark, tmp_path):
    """By the wall clock: nothing arrives after the first trigger, and the stall is told all the same."""
    from quillmill.streaming.progress import progress_alerts

    attempts, targets = lines(spark)
    attempts.where("component = 'runs' AND accepted").limit(3).coalesce(1).write.parquet(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = progress_alerts(spark.readStream.schema(attempts.schema).parquet(str(tmp_path / "in")), targets.where("component = 'runs'"), 2, 1)
    q = stream.writeStream.format("memory").queryName("wall_alerts").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("wall_alerts").where("state = 'no_attempts'").isEmpty():
            time.sleep(1)
    finally:
        q.stop()
        spark.conf.unset(provider)
    assert [r.state for r in spark.table("wall_alerts").orderBy("at_ms").collect()] == ["running", "no_attempts"]
