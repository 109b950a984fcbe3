"""Structured Streaming jobs over progress events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from docweft.functions.text import nonempty
from docweft.operators import progress

WATERMARK = "10 minutes"
IDLE_MS, GRACE_MS, RETENTION_MS = 30 * 60 * 1000, 30 * 1000, 24 * 60 * 60 * 1000


def read_progress(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events from a folder of JSON lines; any source with a ``value`` column works alike."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return progress.decode_events(reader.load(folder))


def live_sessions(events: DataFrame) -> DataFrame:
    """Session state as a streaming aggregate (update or complete mode).

    Built-in aggregates keep the state in the JVM and combine before the shuffle.
    """
    return progress.session_stats(progress.session_state(events))


SESSION_FACTS = (
    "status string, status_ms bigint, start_ms bigint, total bigint, total_ms bigint, current string, current_ms bigint, "
    "first_ms bigint, last_ms bigint, done bigint, errors bigint, warnings bigint"
)
SESSION_ROW = (
    "session_id string, status string, start_ms bigint, total_files bigint, completed_files bigint, current_file string, "
    "errors bigint, warnings bigint, last_ms bigint"
)


def _session_processor(idle_ms: int):
    class Fold(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("session", SESSION_FACTS, idle_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            import pandas as pd

            held = tuple(self.state.get()) if self.state.exists() else ("", -1, -1, 0, -1, "", -1, -1, -1, 0, 0, 0)
            status, status_ms, start_ms, total, total_ms, current, current_ms, first, last, done, errors, warnings = held
            for frame in rows:
                at = frame["ts_ms"].to_numpy()
                status, status_ms = _latest(frame, at, "status", status, status_ms)
                current, current_ms = _latest(frame, at, "current", current, current_ms)
                total, total_ms = _latest(frame, at, "total", total, total_ms)
                started = at[frame["started"].to_numpy(bool)]
                start_ms = max(start_ms, int(started.max())) if len(started) else start_ms
                first = int(at.min()) if first < 0 else min(first, int(at.min()))
                last = max(last, int(at.max()))
                done += int(frame["done"].sum())
                errors += int(frame["failed"].sum())
                warnings += int(frame["warned"].sum())
            total = int(total)
            self.state.update(
                (status, status_ms, start_ms, total, total_ms, current, current_ms, first, last, done, errors, warnings)
            )
            yield pd.DataFrame({
                "session_id": [key[0]], "status": [status or "active"], "start_ms": [start_ms if start_ms >= 0 else first],
                "total_files": [total], "completed_files": [done], "current_file": [current or None],
                "errors": [errors], "warnings": [warnings], "last_ms": [last],
            })

        def close(self) -> None:
            pass

    return Fold()


def _latest(frame, at, column: str, value, value_ms: int):
    """The latest present value of a column and its time, or the one held so far."""
    present = frame[column].notna().to_numpy()
    if not present.any():
        return value, value_ms
    times = at[present]
    newest = int(times.argmax())
    if times[newest] < value_ms:
        return value, value_ms
    return frame[column].to_numpy()[present][newest], int(times[newest])


def bounded_sessions(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """``live_sessions`` with a state that ends: a row for each session with events in a batch (update mode).

    The state of a session is one row with a time to live, which each of its batches renews; after
    ``idle_ms`` without an event the store drops it, and a later event begins the session anew. The time
    is that of the clock, so each trigger runs a batch and ``availableNow`` never ends: run it with a trigger
    interval, as the other clock-driven streams here. What an event says is found in column expressions; Python folds numbers only.
    """
    kind, data = F.col("type"), F.col("data")
    status = (
        F.when(kind == "conversion_start", "active")
        .when(kind == "conversion_complete", "completed")
        .when(kind == "conversion_error", "error")
    )
    facts = events.select(
        "session_id", F.unix_millis("ts").alias("ts_ms"), status.alias("status"),
        (kind == "conversion_start").alias("started"),
        F.when((kind == "conversion_start") & (data["totalFiles"] > 0), data["totalFiles"]).alias("total"),
        F.when(kind == "file_start", nonempty(data["currentFile"])).alias("current"),
        (kind == "file_complete").cast("int").alias("done"),
        (kind.isin("file_error", "conversion_error") & nonempty(data["error"]).isNotNull()).cast("int").alias("failed"),
        ((kind == "file_complete") & nonempty(data["message"]).isNotNull()).cast("int").alias("warned"),
    ).filter("ts_ms is not null")
    folded = facts.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_session_processor(idle_ms), outputStructType=SESSION_ROW, outputMode="Update", timeMode="ProcessingTime"
    )
    state = folded.select(
        "session_id", "status", F.timestamp_millis("start_ms").alias("start_time"), "total_files", "completed_files",
        "current_file", "errors", "warnings", F.timestamp_millis("last_ms").alias("last_update"),
    )
    return progress.session_stats(state.withColumn("eta", progress.eta()))


def closed_spans(events: DataFrame, gap: str = progress.SESSION_TIMEOUT) -> DataFrame:
    """Finished spans (append mode), bounded by the watermark."""
    return progress.session_windows(events.withWatermark("ts", WATERMARK), gap)


ENDS = ["conversion_complete", "conversion_error"]


def _expiry_processor(timeout_ms: int, grace_ms: int, clock: bool):
    class Expire(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            #: Last event and first end of the session; -1 while it has not ended.
            self.seen = handle.getValueState("seen", "last_ms bigint, end_ms bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            last, end = self.seen.get() if self.seen.exists() else (-1, -1)
            was = self._due(last, end)
            for frame in rows:
                # by the clock an event counts when it arrives
                at = frame["ts_ms"] * 0 + timerValues.getCurrentProcessingTimeInMs() if clock else frame["ts_ms"]
                last = max(last, int(at.max()))
                ends = at[frame["type"].isin(ENDS)]
                if len(ends):
                    end = min(x for x in (end, int(ends.min())) if x >= 0)
            due = self._due(last, end)
            self.seen.update((last, end))
            # what comes after the end moves nothing: the timer stays where it is
            if due != was:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            return iter(())

        def _due(self, last: int, end: int) -> int:
            return -1 if last < 0 else end + grace_ms if end >= 0 else last + timeout_ms

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            import pandas as pd

            at = expiredTimerInfo.getExpiryTimeInMs()
            self.seen.clear()
            yield pd.DataFrame({"session_id": [key[0]], "type": ["session_expired"], "expired_ms": [at]})

        def close(self) -> None:
            pass

    return Expire()


def expire_sessions(
    events: DataFrame, timeout_ms: int = IDLE_MS, grace_ms: int = GRACE_MS, watermark: str = WATERMARK, clock: bool = False
) -> DataFrame:
    """``session_expired`` rows: after 30 minutes of silence, or 30 seconds after the first end
    event whatever follows it.

    Event-time timers fire when the watermark passes, so a stream that falls quiet expires nothing. With
    ``clock`` an event counts at its arrival and timers fire by the clock, also in a quiet stream, as the
    sweep of the original does. State is one row per session.
    """
    keyed = events.select("session_id", "type", "ts", F.unix_millis("ts").alias("ts_ms")).filter("ts is not null")
    keyed = keyed if clock else keyed.withWatermark("ts", watermark)
    return keyed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_expiry_processor(timeout_ms, grace_ms, clock),
        outputStructType="session_id string, type string, expired_ms bigint",
        outputMode="Append",
        timeMode="ProcessingTime" if clock else "EventTime",
    )


def _retention_processor(age_ms: int):
    class Retain(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            #: Time of the newest row of the report, and its end; -1 while it runs.
            self.held = handle.getValueState("report", "ts_ms bigint, end_ms bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            was = self.held.exists()
            newest, end = self.held.get() if was else (-1, -1)
            for frame in rows:
                k = int(frame["ts_ms"].to_numpy().argmax())
                if frame["ts_ms"].iloc[k] >= newest:
                    newest, end = int(frame["ts_ms"].iloc[k]), int(frame["end_ms"].iloc[k])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if end >= 0 and end + age_ms < timerValues.getCurrentProcessingTimeInMs():
                self.held.clear()
                if was:
                    yield self._row(key, "report_dropped", end)
                return
            self.held.update((newest, end))
            if end >= 0:
                self.handle.registerTimer(end + age_ms)
            yield self._row(key, "report_kept", end)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            end = self.held.get()[1] if self.held.exists() else -1
            self.held.clear()
            yield self._row(key, "report_dropped", end)

        def _row(self, key, kind: str, end: int):
            import pandas as pd

            return pd.DataFrame({"report_id": [key[0]], "type": [kind], "end_ms": pd.array([end if end >= 0 else None], "Int64")})

        def close(self) -> None:
            pass

    return Retain()


def retained_reports(reports: DataFrame, age_ms: int = RETENTION_MS) -> DataFrame:
    """The stream form of ``recent_reports``: ``report_id, type, end_ms`` for each change (append mode).

    ``reports`` has ``report_id, ts, end_time``; of the rows of a report the latest by ``ts`` counts. A report that
    runs, or ended at most ``age_ms`` ago, is ``report_kept``; when that time is over by the clock it is
    ``report_dropped`` and its state goes, in a quiet stream as well. One that is too old when it first
    arrives is never told. State is one row for each report held.
    """
    rows = reports.select(
        "report_id", F.unix_millis("ts").alias("ts_ms"), F.coalesce(F.unix_millis("end_time"), F.lit(-1)).alias("end_ms")
    ).filter("report_id is not null and ts_ms is not null")
    return rows.groupBy("report_id").transformWithStateInPandas(
        statefulProcessor=_retention_processor(age_ms), outputStructType="report_id string, type string, end_ms bigint",
        outputMode="Append", timeMode="ProcessingTime",
    )


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there now and stop; rows are written to a Parquet folder.

    Appended rows go through the file sink, each exactly once. In the other modes each
    batch replaces the folder's content.
    """
    writer = stream.writeStream.outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", folder)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(folder))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_batch(stream: DataFrame, callback, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Call ``callback(batch, batch_id)`` with each updated batch."""
    return (
        stream.writeStream.foreachBatch(callback)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class ProgressListener(StreamingQueryListener):
    """Passes what happens to streaming queries on to ``callback`` as a dict, for all queries or those of one name.

    ``type`` is started, progress, idle, terminated or failed; progress has the batch, its input rows, rows
    a second and rows of state. An error in the callback is not passed to the query.
    """

    def __init__(self, callback, name: str | None = None):
        self.callback, self.name, self.runs = callback, name, set()

    def onQueryStarted(self, event) -> None:
        if self.name in (None, event.name):
            self.runs.add(str(event.runId))
            self.callback({"type": "started", "run": str(event.runId), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) in self.runs:
            self.callback({
                "type": "progress", "run": str(p.runId), "name": p.name, "batch": p.batchId, "rows": p.numInputRows,
                "rows_per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
            })

    def onQueryIdle(self, event) -> None:
        if str(event.runId) in self.runs:
            self.callback({"type": "idle", "run": str(event.runId)})

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if run in self.runs:
            self.runs.discard(run)
            self.callback({"type": "failed" if event.exception else "terminated", "run": run, "error": event.exception})


def listen(spark: SparkSession, callback, name: str | None = None) -> ProgressListener:
    """Registers a listener; ``spark.streams.removeListener`` takes it away."""
    listener = ProgressListener(callback, name)
    spark.streams.addListener(listener)
    return listener
