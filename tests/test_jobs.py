"""Jobs that read and write files: corpus scan, sinks, streams."""

import json
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

from docweft.operators import progress, variables
from docweft.sources import corpus
from docweft.streaming import progress as streams

START = 1_700_000_000_000


def folder():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def test_scan(spark):
    root = folder()
    write(root, {
        "Content/a.htm": "<h1>é</h1>", "Content/sub/b.xml": "<x/>", "Output/c.htm": "x", "Content/.git/d.htm": "x",
        "Content/my-temp/e.htm": "x", "Content/f.exe": "x", "Content/~g.htm": "x", "Project/VariableSets/v.flvar": "<v/>",
    })
    files = corpus.scan_corpus(spark, str(root))
    got = {r["path"]: (r["ext"], r["depth"], r["content"]) for r in files.collect()}
    assert set(got) == {"Content/a.htm", "Content/sub/b.xml", "Project/VariableSets/v.flvar"}
    assert got["Content/a.htm"] == ("htm", 1, "<h1>é</h1>")
    flat = corpus.scan_corpus(spark, str(root / "Content"), recursive=False, glob="*.htm")
    assert [r["path"] for r in flat.collect()] == ["a.htm"]
    plan = corpus.scan_corpus(spark, str(root)).select("path")._jdf.queryExecution().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_scan_pushes_its_filters(spark):
    root = folder()
    write(root, {"a.HTM": "x", "b.xml": "<x/>", "c.htm": "y" * 500, "d.html": "é"})
    files = corpus.scan_corpus(spark, f"file://{root}", extensions=["htm", "html"], max_bytes=100)
    assert sorted((r["path"], r["content"]) for r in files.collect()) == [("a.HTM", "x"), ("d.html", "é")]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan.split("PushedFilters")[-1]
    assert sorted(r["path"] for r in corpus.scan_corpus(spark, str(root)).select("path").collect()) == ["a.HTM", "b.xml", "c.htm", "d.html"]


def test_scan_as_a_stream(spark):
    """Each file once, in batches of bounded number; what appears later is found by the next run."""
    root, out = folder(), folder()
    write(root, {f"Content/p{k}.htm": f"<p>{k}</p>" for k in range(5)} | {"Output/x.htm": "x", "Content/big.htm": "z" * 500, "Content/n.xml": "<n/>"})

    def run():
        rows = corpus.stream_corpus(spark, str(root), ["htm"], max_bytes=100, files_per_batch=2).select("path", "content")
        job = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
        assert job.awaitTermination(120)
        return sorted((r["path"], r["content"]) for r in spark.read.parquet(f"{out}/rows").collect())

    want = [(f"Content/p{k}.htm", f"<p>{k}</p>") for k in range(5)]
    assert run() == want
    write(root, {"Content/q.htm": "new"})
    assert run() == sorted([*want, ("Content/q.htm", "new")])


def test_sinks(spark):
    root = folder()
    vars_df = spark.createDataFrame([(2, "B", "x"), (1, "A.C", "y")], "ord int, name string, value string")
    rendered = variables.render_variables(variables.to_extracted(vars_df), "asciidoc", grouped=True)
    topics = spark.createDataFrame([("a", "asciidoc", "t"), ("b", "markdown", "t")], "path string, format string, text string")
    report = spark.createDataFrame([(1,)], "total int")
    corpus.write_outputs({"variables": rendered, "topics": topics, "report": report}, str(root))
    text = "\n".join(p.read_text() for p in sorted((root / "variables").glob("part-*")))
    assert [x for x in text.split("\n") if x.startswith((":", "// A"))] == [":b: x", "// A Variables", ":a-c: y"]
    assert (root / "topics" / "format=asciidoc").is_dir()
    assert spark.read.parquet(str(root / "report")).count() == 1


def events():
    def e(session, kind, second, **data):
        return {"sessionId": session, "type": kind, "timestamp": START + second * 1000, "data": data}

    return [
        e("s", "conversion_start", 0, totalFiles=4),
        e("s", "file_start", 1, currentFile="a.htm"),
        e("s", "file_complete", 10, message="slow"),
        e("s", "file_complete", 20),
        e("s", "file_error", 25, error="bad"),
        e("t", "conversion_start", 0, totalFiles=1),
        e("t", "conversion_complete", 5),
    ]


def test_batch_state(spark):
    raw = spark.createDataFrame([(json.dumps(e),) for e in events()] + [("junk",)], "value string")
    decoded = progress.decode_events(raw)
    assert decoded.count() == 7
    stats = {r["session_id"]: r for r in progress.session_stats(progress.session_state(decoded)).collect()}
    s = stats["s"]
    assert (s["completed_files"], s["errors"], s["warnings"], s["status"], s["percent"]) == (2, 1, 1, "active", 50.0)
    assert s["current_file"] == "a.htm"
    assert stats["t"]["status"] == "completed"
    at20 = progress.session_stats(progress.session_state(decoded.filter(F.col("ts") <= F.timestamp_millis(F.lit(START + 20000)))))
    r = at20.filter("session_id = 's'").select(
        "files_per_second", F.unix_millis("eta").alias("eta")
    ).first()
    assert r["files_per_second"] == 0.1 and r["eta"] == START + 40000
    assert progress.active_sessions(progress.session_state(decoded)).first()[0] == 1


def test_live_sessions_equal_batch(spark):
    root = folder()
    for i, chunk in enumerate((events()[:3], events()[3:])):
        (root / f"{i}.json").write_text("\n".join(json.dumps(e) for e in chunk))
    stream = streams.live_sessions(streams.read_progress(spark, str(root), files_per_trigger=1))
    out = str(folder() / "live")
    query = streams.run_available(stream, out, str(folder()), "complete")
    assert query.awaitTermination(120)
    raw = spark.createDataFrame([(json.dumps(e),) for e in events()], "value string")
    batch = progress.session_stats(progress.session_state(progress.decode_events(raw)))
    columns = ["session_id", "status", "completed_files", "errors", "percent", "elapsed_ms"]
    assert sorted(map(tuple, spark.read.parquet(out).select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_closed_spans(spark):
    root = folder()
    late = [{"sessionId": "s", "type": "file_start", "timestamp": START + 7_200_000, "data": {}},
            {"sessionId": "u", "type": "file_start", "timestamp": START + 20_000_000, "data": {}}]
    (root / "0.json").write_text("\n".join(json.dumps(e) for e in events() + late))
    out = str(folder() / "spans")
    query = streams.run_available(streams.closed_spans(streams.read_progress(spark, str(root))), out, str(folder()))
    assert query.awaitTermination(120)
    got = sorted((r["session_id"], r["events"]) for r in spark.read.parquet(out).collect())
    assert got == [("s", 1), ("s", 5), ("t", 2)]


def rocksdb(spark):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def wait_for(test, seconds=90):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.5)
    return test()


def running(stream, mode, checkpoint, name=None):
    """A query that goes on, and the rows it has put out so far."""
    out = []
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime="1 second")
    writer = writer.queryName(name) if name else writer
    return writer.foreachBatch(lambda batch, number: out.extend(batch.collect())).start(), out


def test_bounded_sessions_equal_batch(spark):
    rocksdb(spark)
    root = folder()
    more = [{"sessionId": "s", "type": "file_start", "timestamp": START + 500, "data": {"currentFile": "late.htm"}}]
    for i, chunk in enumerate((events()[3:], events()[:3], more)):
        (root / f"{i}.json").write_text("\n".join(json.dumps(e) for e in chunk))
    rows = streams.bounded_sessions(streams.read_progress(spark, str(root), files_per_trigger=1))
    query, out = running(rows, "update", str(folder()))
    try:
        assert wait_for(lambda: len(out) >= 4), query.exception()
    finally:
        query.stop()
    last = {r["session_id"]: r for r in out}
    raw = spark.createDataFrame([(json.dumps(e),) for e in events() + more], "value string")
    batch = progress.session_stats(progress.session_state(progress.decode_events(raw)))
    assert set(rows.columns) == set(batch.columns)
    want = {r["session_id"]: r.asDict() for r in batch.collect()}
    assert {k: r.asDict() for k, r in last.items()} == want


def test_state_of_idle_sessions_goes(spark):
    rocksdb(spark)
    root = folder()
    rows = streams.bounded_sessions(streams.read_progress(spark, str(root)), idle_ms=12_000)

    def put(number, session):
        event = {"sessionId": session, "type": "file_complete", "timestamp": START, "data": {}}
        (root / f"{number}.json").write_text(json.dumps(event))

    def states():
        progress = query.lastProgress
        return progress.stateOperators[0].numRowsTotal if progress else -1

    put(0, "a")
    query, out = running(rows, "update", str(folder()))
    try:
        assert wait_for(lambda: len(out) == 1)
        put(1, "a")
        assert wait_for(lambda: len(out) == 2)
        assert wait_for(lambda: states() > 0)
        assert wait_for(lambda: states() == 0)
        put(2, "a")
        assert wait_for(lambda: len(out) == 3)
    finally:
        query.stop()
    # what was held of the session is gone: its third event counts as the first
    assert [r["completed_files"] for r in out] == [1, 2, 1]


def test_clock_expires_a_quiet_stream(spark):
    rocksdb(spark)
    root = folder()
    ended = [{"sessionId": "e", "type": "conversion_complete", "timestamp": START, "data": {}}]
    (root / "0.json").write_text("\n".join(json.dumps(e) for e in events()[:3] + ended))
    began = time.time() * 1000
    stream = streams.expire_sessions(streams.read_progress(spark, str(root)), timeout_ms=4000, grace_ms=1000, clock=True)
    query, out = running(stream, "append", str(folder()))
    try:
        assert wait_for(lambda: len(out) >= 2)
        assert query.exception() is None
    finally:
        query.stop()
    at = {r["session_id"]: r["expired_ms"] for r in out}
    assert len(out) == 2 and set(at) == {"s", "e"}
    assert at["s"] - at["e"] == 3000 and at["e"] >= began + 1000


def test_retained_reports(spark):
    rocksdb(spark)
    root, now = folder(), int(time.time() * 1000)
    age, soon = streams.RETENTION_MS, 25_000
    rows = [
        ("old", now - 10, now - age - 60_000), ("running", now, None), ("new", now, now - 1000),
        ("soon", now, now - age + soon), ("again", now - 5, now - age - 60_000), ("again", now, None),
    ]
    (root / "0.json").write_text("\n".join(json.dumps({"report_id": r, "ts": t, "end_time": e}) for r, t, e in rows))
    raw = spark.readStream.schema("report_id string, ts bigint, end_time bigint").json(str(root))

    def timed(df):
        return df.select("report_id", F.timestamp_millis("ts").alias("ts"), F.timestamp_millis("end_time").alias("end_time"))

    query, out = running(streams.retained_reports(timed(raw)), "append", str(folder()))
    try:
        assert wait_for(lambda: any(r["type"] == "report_dropped" for r in out)), query.exception()
    finally:
        query.stop()
    held = set()
    for r in out:
        (held.add if r["type"] == "report_kept" else held.discard)(r["report_id"])
    static = spark.createDataFrame(rows, "report_id string, ts bigint, end_time bigint")
    newest = timed(static).groupBy("report_id").agg(F.max_by("end_time", "ts").alias("end_time"))
    batch = progress.recent_reports(newest, F.timestamp_millis(F.lit(now + soon + 1000)))
    assert held == {r["report_id"] for r in batch.collect()} == {"running", "new", "again"}
    assert {r["report_id"] for r in out} == held | {"soon"}


def test_listener(spark):
    root, told = folder(), []
    (root / "0.json").write_text("\n".join(json.dumps(e) for e in events()))
    listener = streams.listen(spark, told.append, "watched")
    try:
        for name in ("watched", "other"):
            query, _ = running(progress.session_state(streams.read_progress(spark, str(root))), "update", str(folder()), name)
            query.processAllAvailable()
            query.stop()
        assert wait_for(lambda: told and told[-1]["type"] == "terminated")
    finally:
        spark.streams.removeListener(listener)
    assert told[0]["type"] == "started" and {x["type"] for x in told} <= {"started", "progress", "idle", "terminated"}
    assert len({x["run"] for x in told}) == 1
    assert [(x["rows"], x["state_rows"]) for x in told if x["type"] == "progress" and x["rows"]] == [(7, 2)]


def test_listener_tells_failure(spark):
    root, told = folder(), []
    (root / "0.json").write_text(json.dumps(events()[0]))
    listener = streams.listen(spark, told.append)
    bad = streams.read_progress(spark, str(root)).withColumn("x", F.raise_error(F.lit("broken on purpose")))
    try:
        query, _ = running(bad, "append", str(folder()))
        wait_for(lambda: query.exception() is not None)
        assert wait_for(lambda: told and told[-1]["type"] == "failed")
    finally:
        spark.streams.removeListener(listener)
    assert "broken on purpose" in told[-1]["error"]


def test_expiry(spark):
    rocksdb(spark)
    root = folder()
    late = [{"sessionId": "u", "type": "file_start", "timestamp": START + 20_000_000, "data": {}}]
    after_end = [{"sessionId": "t", "type": "file_complete", "timestamp": START + 5_000 + k * 9_000, "data": {}} for k in (1, 2)]
    (root / "0.json").write_text("\n".join(json.dumps(e) for e in events()))
    (root / "1.json").write_text("\n".join(json.dumps(e) for e in after_end))
    (root / "2.json").write_text("\n".join(json.dumps(e) for e in late))
    stream = streams.expire_sessions(streams.read_progress(spark, str(root), files_per_trigger=1))
    out = str(folder() / "expired")
    query = streams.run_available(stream, out, str(folder()))
    assert query.awaitTermination(180)
    got = sorted((r["session_id"], r["expired_ms"] - START) for r in spark.read.parquet(out).collect())
    assert got == [("s", 25_000 + 1_800_000), ("t", 5_000 + 30_000)]


def test_batch_callback(spark):
    root, seen = folder(), []
    (root / "0.json").write_text("\n".join(json.dumps(e) for e in events()))
    stream = progress.session_state(streams.read_progress(spark, str(root)))
    query = streams.on_batch(stream, lambda batch, number: seen.append(batch.count()), str(folder()))
    assert query.awaitTermination(120)
    assert sum(seen) == 2


def test_steps(spark):
    steps = spark.createDataFrame(
        [("r", 1, "completed", 100), ("r", 2, "in_progress", 50), ("r", 3, "skipped", 0), ("r", 4, "pending", 0)],
        "report_id string, step_id int, status string, progress int",
    )
    assert progress.step_progress(steps).first()["overall_progress"] == 63
    left = spark.range(1).select(progress.remaining_ms(F.lit(25), F.lit(1000)).alias("x")).first()[0]
    assert left == 3000
