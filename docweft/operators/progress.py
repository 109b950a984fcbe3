"""Progress events folded to session and step state.

The same functions take a batch or a streaming DataFrame: they are aggregations
that combine before the shuffle, so one session may hold a third of all events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweft.functions.text import nonempty, round_half_up

# --- fixed values -----------------------------------------------------------
EVENT_TYPES = [
    "conversion_start", "file_start", "file_progress", "file_complete", "file_error",
    "conversion_complete", "conversion_error", "connection_established", "session_expired",
]
EVENT_DATA = (
    "struct<totalFiles:int,completedFiles:int,currentFileIndex:int,overallPercentage:double,currentFile:string,"
    "currentFilePercentage:double,message:string,phase:string,error:string,errorStack:string,startTime:bigint,"
    "estimatedCompletionTime:bigint,processedSize:bigint,totalSize:bigint,filesPerSecond:double,"
    "warnings:array<string>>"
)
SESSION_TIMEOUT = "30 minutes"
RETENTION = "24 hours"
# ---------------------------------------------------------------------------


def decode_events(raw: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """JSON text to ``session_id, type, ts, data``; unknown types and bad JSON are dropped.

    ``keep`` names columns of ``raw`` that are passed on.
    """
    schema = f"struct<sessionId:string,type:string,timestamp:bigint,data:{EVENT_DATA}>"
    e = F.from_json(F.col(column), schema)
    keep = keep or []
    rows = raw.select(*keep, e.alias("e")).select(
        *keep,
        F.col("e.sessionId").alias("session_id"), F.col("e.type").alias("type"),
        F.timestamp_millis("e.timestamp").alias("ts"), F.col("e.data").alias("data"),
    )
    return rows.filter(F.col("type").isin(EVENT_TYPES) & F.col("session_id").isNotNull())


def encode_events(events: DataFrame) -> DataFrame:
    """The JSON text of each event, as ``value``."""
    return events.select(
        F.to_json(
            F.struct(
                F.col("session_id").alias("sessionId"), "type", F.unix_millis("ts").alias("timestamp"), "data"
            )
        ).alias("value")
    )


def session_state(events: DataFrame) -> DataFrame:
    """Folded state per session, with estimate and statistics at the last update.

    ``seq`` (or, without it, ``ts``) is the arrival order.
    """
    order = F.col("seq") if "seq" in events.columns else F.col("ts")
    kind, data = F.col("type"), F.col("data")

    def at(test: Column, value: Column) -> Column:
        return F.max_by(F.when(test, value), F.when(test, order))

    status = (
        F.when(kind == "conversion_start", "active")
        .when(kind == "conversion_complete", "completed")
        .when(kind == "conversion_error", "error")
    )
    total = data["totalFiles"]
    failed = kind.isin("file_error", "conversion_error")
    state = events.groupBy("session_id").agg(
        F.coalesce(at(status.isNotNull(), status), F.lit("active")).alias("status"),
        F.coalesce(at(kind == "conversion_start", F.col("ts")), F.min("ts")).alias("start_time"),
        F.coalesce(at((kind == "conversion_start") & (total > 0), total), F.lit(0)).cast("bigint").alias("total_files"),
        F.count_if(kind == "file_complete").alias("completed_files"),
        at((kind == "file_start") & nonempty(data["currentFile"]).isNotNull(), data["currentFile"]).alias("current_file"),
        F.count_if(failed & nonempty(data["error"]).isNotNull()).alias("errors"),
        F.count_if((kind == "file_complete") & nonempty(data["message"]).isNotNull()).alias("warnings"),
        F.max_by(F.col("ts"), order).alias("last_update"),
    )
    return state.withColumn("eta", eta())


def _elapsed_ms() -> Column:
    return F.unix_millis("last_update") - F.unix_millis("start_time")


def eta() -> Column:
    """Last update plus the mean time per file times the files left."""
    left = F.col("total_files") - F.col("completed_files")
    per_file = F.try_divide(_elapsed_ms().cast("double"), F.col("completed_files").cast("double"))
    ready = (F.col("completed_files") > 0) & (F.col("total_files") > 0)
    when = F.unix_millis("last_update") + F.floor(per_file * left).cast("bigint")
    return F.when(ready, F.timestamp_millis(when))


def session_stats(state: DataFrame) -> DataFrame:
    """Elapsed ms, files per second and percent done."""
    done = F.col("completed_files").cast("double")
    rate = F.when(
        F.col("completed_files") > 0, F.try_divide(done, _elapsed_ms() / F.lit(1000.0))
    ).otherwise(F.lit(0.0))
    percent = F.when(F.col("total_files") > 0, done / F.col("total_files") * 100).otherwise(F.lit(0.0))
    return state.select(
        "*", _elapsed_ms().alias("elapsed_ms"), rate.alias("files_per_second"), percent.alias("percent")
    )


def active_sessions(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if(F.col("status") == "active").alias("active_sessions"))


def session_windows(events: DataFrame, gap: str = SESSION_TIMEOUT) -> DataFrame:
    """Spans of a session parted by a pause of ``gap``; the end of a span is its expiry.

    A span closes at a pause of at least the gap. In a batch, events are first
    combined per session and time slot of one gap, whose events always belong
    together; what is left per session is bounded by its duration, however many
    events it has. A stream uses the built-in session window.
    """
    out = ["session_id", "start_time", "expires_at", "last_update", "events"]
    if events.isStreaming:
        w = F.session_window("ts", gap)
        spans = events.groupBy("session_id", w).agg(F.count("*").alias("events"), F.max("ts").alias("last_update"))
        return spans.select(
            "session_id", F.col("session_window.start").alias("start_time"),
            F.col("session_window.end").alias("expires_at"), "last_update", "events",
        )
    slots = events.groupBy("session_id", F.window("ts", gap)["start"].alias("slot")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")
    )
    order = Window.partitionBy("session_id").orderBy("slot")
    pause = F.expr(f"INTERVAL {gap}")
    before = F.lag("last").over(order)
    opens = F.when(before.isNull() | (F.col("first") >= before + pause), 1).otherwise(0)
    marked = slots.withColumn("opens", opens).withColumn("span", F.sum("opens").over(order))
    spans = marked.groupBy("session_id", "span").agg(
        F.min("first").alias("start_time"), F.max("last").alias("last_update"), F.sum("n").alias("events")
    )
    return spans.withColumn("expires_at", F.col("last_update") + pause).select(*out)


def step_progress(steps: DataFrame) -> DataFrame:
    """Overall percent per report: done and skipped steps count full, running ones their share."""
    share = (
        F.when(F.col("status").isin("completed", "skipped"), F.lit(100.0))
        .when(F.col("status") == "in_progress", F.coalesce(F.col("progress").cast("double"), F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )

    def number(status):
        return F.count_if(F.col("status") == status)

    return steps.groupBy("report_id").agg(
        F.count("*").alias("total_steps"),
        number("completed").alias("completed_steps"),
        number("failed").alias("failed_steps"),
        number("skipped").alias("skipped_steps"),
        round_half_up(F.avg(share)).alias("overall_progress"),
    )


def remaining_ms(overall: Column, elapsed_ms: Column) -> Column:
    """Milliseconds left at the rate so far; null when not running."""
    running = (overall > 0) & (overall < 100)
    return F.when(running, round_half_up((100 - overall) * elapsed_ms / overall))


def step_durations(step_events: DataFrame, tasks: int | None = None) -> DataFrame:
    """Last status and duration per step from its status events.

    Steps have few events each, so hardly any combine before the shuffle, and the memory of a task
    grows with its steps: ``tasks`` deals the events out to so many tasks, whatever their bytes.
    """
    if tasks is not None:
        step_events = step_events.repartition(tasks, "report_id", "step_id")
    kind = F.col("status")
    closed = kind.isin("completed", "failed", "skipped")
    state = step_events.groupBy("report_id", "step_id").agg(
        F.max_by("status", "ts").alias("status"),
        F.max(F.when(kind == "in_progress", F.col("ts"))).alias("start_time"),
        F.max(F.when(closed, F.col("ts"))).alias("end_time"),
    )
    ms = F.unix_millis("end_time") - F.unix_millis("start_time")
    return state.select("*", F.when(F.col("end_time") >= F.col("start_time"), ms).alias("duration_ms"))


def recent_reports(reports: DataFrame, now: Column | None = None, age: str = RETENTION) -> DataFrame:
    """Reports that are not finished or finished within ``age``."""
    now = F.current_timestamp() if now is None else now
    return reports.filter(F.col("end_time").isNull() | (F.col("end_time") >= now - F.expr(f"INTERVAL {age}")))
