"""Progress lines (component, ts): board and accepted rates, the same code for batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def progress_board(lines: DataFrame, idle_seconds: int = 1200) -> DataFrame:
    """Batch: rows and last time of each component, stalled where it lags the newest line by over idle_seconds."""
    last = lines.groupBy("component").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    newest = lines.agg(F.max("ts").alias("newest"))  # one row
    return last.join(F.broadcast(newest)).select("component", "n", "last_ts", (F.unix_timestamp("newest") - F.unix_timestamp("last_ts") > idle_seconds).alias("stalled"))


def progress_counts(lines: DataFrame) -> DataFrame:
    """(component, n, last_ts): what the board is made of; on a stream it is kept for each component and updated."""
    return lines.groupBy("component").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def progress_states(accepted: DataFrame, attempts: DataFrame, targets: DataFrame, idle_seconds: int = 1200, silent_seconds: int = 300) -> DataFrame:
    """(component, n, target, n_attempts, state) for each component of targets (component, target), from counts of accepted
    rows and of attempts: target met; running where a row came within idle_seconds of the newest line of all; else
    nothing_accepted where attempts still came within silent_seconds, or no_attempts."""
    rows = accepted.select("component", "n", F.col("last_ts").alias("row_ts"))
    tries = attempts.select("component", F.col("n").alias("n_attempts"), F.col("last_ts").alias("try_ts"))
    newest = accepted.select("last_ts").union(attempts.select("last_ts")).agg(F.max("last_ts").alias("newest"))  # one row
    all_ = targets.select("component", "target").join(rows, "component", "left").join(tries, "component", "left").join(F.broadcast(newest))
    idle = lambda ts: F.unix_timestamp("newest") - F.unix_timestamp(ts)
    state = F.when(F.coalesce("n", F.lit(0)) >= F.col("target"), "target met").when(idle("row_ts") <= idle_seconds, "running").when(idle("try_ts") <= silent_seconds, "nothing_accepted").otherwise("no_attempts")
    return all_.select("component", F.coalesce("n", F.lit(0)).alias("n"), "target", F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"), state.alias("state"))


def accept_rates(attempts: DataFrame, width: str = "10 minutes", watermark: str = "30 minutes") -> DataFrame:
    """(component, window_start, attempts, accepted, rate) of attempts (component, ts, accepted): how many of a window's
    attempts were accepted. On a stream, windows close when the watermark passes them."""
    if attempts.isStreaming:
        attempts = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    counted = attempts.groupBy("component", F.window("ts", width).alias("w")).agg(F.count("*").alias("attempts"), F.count_if("accepted").alias("accepted"))
    return counted.select("component", F.col("w.start").alias("window_start"), "attempts", "accepted", (F.col("accepted") / F.col("attempts")).alias("rate"))


def rate_windows(lines: DataFrame, width: str = "10 minutes", watermark: str = "30 minutes") -> DataFrame:
    """Accepted lines of each component and window; on a stream, windows close when the watermark passes them."""
    if lines.isStreaming:
        lines = lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)  # watermarks need a zoned time
    counted = lines.groupBy("component", F.window("ts", width).alias("w")).agg(F.count("*").alias("accepted"))
    return counted.select("component", F.col("w.start").alias("window_start"), "accepted")


def dedup_stream(rows: DataFrame, key: str, watermark: str = "30 minutes") -> DataFrame:
    """First row of each key. On a stream the keys seen are kept until the watermark passes them, so a copy that comes
    later than that counts as new; a batch keeps the row of least ts."""
    if rows.isStreaming:
        return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
    best = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), "ts").alias("_row"))
    return best.select(key, "_row.*").select(rows.columns)


class _Seen(StatefulProcessor):
    """One flag a key, set by the seed or by the key's first row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda r: (r["ts"] is not None, r["ts"]))

    def close(self) -> None:
        pass


def dedup_stream_seeded(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """First row (by ts) of each key among arriving rows, without the keys of `seen`, a batch table such as the rows a
    resumed run already has: its keys are put into the state before the first trigger. Keys are kept for good, in the
    RocksDB state store; rows of a null key are copies of each other. The batch form is exact_dedup over both tables."""
    seeds = seen.select(key).distinct().groupBy(key)
    return rows.groupBy(key).transformWithState(_Seen(), rows.schema, "Append", "None", initialState=seeds)


ALERT = "component string, state string, at_ms long, n long, n_attempts long"


def alert_step(n: int, target: int | None, row_ms: int | None, try_ms: int | None, now: int, idle_ms: int, silent_ms: int) -> tuple[str, int | None]:
    """(progress_states()'s state at the time now, the first time at which it changes without a new line); times in
    milliseconds, compared by whole seconds as the board does."""
    if target is not None and n >= target:
        return "target met", None
    if row_ms is not None and now // 1000 - row_ms // 1000 <= idle_ms // 1000:
        return "running", (row_ms // 1000 + idle_ms // 1000 + 1) * 1000
    if try_ms is not None and now // 1000 - try_ms // 1000 <= silent_ms // 1000:
        return "nothing_accepted", (try_ms // 1000 + silent_ms // 1000 + 1) * 1000
    return "no_attempts", None


class _Alerts(StatefulProcessor):
    """Counts and last times of a component, the state told last; one timer at the time its state would change."""

    def __init__(self, idle_ms: int, silent_ms: int, clock: str):
        self.idle_ms, self.silent_ms, self.clock = idle_ms, silent_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.goal = handle.getValueState("goal", "target long")
        self.counts = handle.getValueState("counts", "n long, n_attempts long, row_ms long, try_ms long")
        self.told = handle.getValueState("told", "state string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.goal.update((initialState["target"],))
        # a component that never gets a line is told of at the first sign that time goes on
        self.handle.registerTimer(1 if self.clock == "EventTime" else timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def _tell(self, key, now: int) -> Iterator[Row]:
        n, tries, row_ms, try_ms = self.counts.get() if self.counts.exists() else (0, 0, None, None)
        target = self.goal.get()[0] if self.goal.exists() else None
        state, change = alert_step(n, target, row_ms, try_ms, now, self.idle_ms, self.silent_ms)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if change is not None:
            self.handle.registerTimer(change)
        if not self.told.exists() or self.told.get()[0] != state:
            self.told.update((state,))
            yield Row(component=key[0], state=state, at_ms=now, n=n, n_attempts=tries)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n, tries, row_ms, try_ms = self.counts.get() if self.counts.exists() else (0, 0, None, None)
        for r in rows:
            tries, try_ms = tries + 1, max(try_ms or r["ms"], r["ms"])
            if r["accepted"]:
                n, row_ms = n + 1, max(row_ms or r["ms"], r["ms"])
        self.counts.update((n, tries, row_ms, try_ms))
        yield from self._tell(key, try_ms if self.clock == "EventTime" else timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._tell(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def progress_alerts(lines: DataFrame, targets: DataFrame, idle_seconds: int = 1200, silent_seconds: int = 300, clock: str = "ProcessingTime", delay: str = "0 seconds") -> DataFrame:
    """(component, state, at_ms, n, n_attempts): one row whenever a component's state becomes another, also without new lines.

    lines: a stream of attempts (component, ts, accepted); targets: a batch table (component, target), one row each.
    States are those of progress_states(). clock "ProcessingTime" measures silence by the wall clock, with the lines' arrival
    as their time; "EventTime" by the newest line of all components, for replays. RocksDB state store.
    """
    rows = lines.select("component", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("accepted", F.lit(False)).alias("accepted"))
    if clock == "EventTime":
        rows = rows.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    else:
        rows = rows.withColumn("ms", F.unix_millis(F.current_timestamp()))
    seeds = targets.select(F.col("component"), F.col("target").cast("long").alias("target")).groupBy("component")
    return rows.groupBy("component").transformWithState(_Alerts(idle_seconds * 1000, silent_seconds * 1000, clock), ALERT, "Append", clock, initialState=seeds)
