"""The drained stream must equal the batch fold, whatever the arrival order."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from proofgrid.streaming import events as ev

START = datetime(2026, 1, 1)


def log_rows():
    rows = []
    for c in range(3):
        for i, status in enumerate(["running", "running", "failed", "running", "complete"]):
            rows.append((f"e{c}{i}", f"case{c}", "imagery", status, f"m{i}", i if i % 2 else None, START + timedelta(minutes=i + c)))
    return rows


def fold(df):
    return ev.stage_fold(df, case="case_id", stage="stage", status="status", message="message", time="created_at", event="id", items="item_count")


def test_stream_equals_batch(spark, tmp_path):
    rows = log_rows()
    for n, part in enumerate((rows[8:], rows[:8])):  # later events arrive first
        spark.createDataFrame(part, ev.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        state = fold(ev.read_log(spark, str(tmp_path / "log"), stream=True))
        ev.drain(state, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, fold(ev.read_log(spark, str(tmp_path / "log"))).collect()))
    assert got == want and len(got) == 3
    first = got[0]
    assert first[2] == START and first[4] == "complete" and first[6] == 3


def test_duplicates_are_dropped(spark, tmp_path):
    rows = log_rows()
    spark.createDataFrame(rows + rows[:4], ev.EVENT_SCHEMA).write.parquet(str(tmp_path / "log"))
    assert ev.distinct_events(ev.read_log(spark, str(tmp_path / "log"))).count() == len(rows)
    once = ev.distinct_events(ev.read_log(spark, str(tmp_path / "log"), stream=True), delay="2 hours")
    ev.follow(once, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_ingest_metrics(spark, tmp_path):
    files = spark.createDataFrame([("b", 10), ("b", 20), ("c", 5)], "batch string, size long")
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    ev.ingest_metrics(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), batch="batch", size="size", max_bytes=25).awaitTermination()
    got = {r.batch: (r.files, r.bytes, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"b": (2, 30, False), "c": (1, 5, True)}


def test_jobs_time_out_by_timer_over_micro_batches(spark, tmp_path):
    """Ready, failed, incomplete, late and timed-out jobs over four micro-batches equal the batch fold at the last watermark."""
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [
        [("a", at(0), 1, "running", None), ("b", at(1), 2, "queued", None), ("c", at(2), 3, "running", None), ("d", at(3), 4, "running", None)],
        [("a", at(20), 5, "ready", True), ("b", at(21), 6, "failed", None), ("c", at(22), 7, "ready", False), ("a", at(19), 8, "running", None)],
        [("e", at(70), 9, "running", None), ("a", at(75), 10, "failed", None), (None, at(75), 11, "running", None), ("x", None, 12, "ready", True)],
        [("f", at(80), 13, "running", None), ("d", at(90), 14, "ready", True), ("e", at(90), 14, "running", None), ("e", at(90), 15, None, None)],
    ]
    schema = "job string, ts timestamp, id bigint, status string, complete boolean"
    seen = []
    columns = dict(job="job", status="status", time="ts", ident="id", complete=F.col("complete"), window_seconds=3600)
    for part in batches:  # one run per batch: the state, its timers and the watermark survive a restart
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        ev.monitor_jobs(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), delay="5 minutes", **columns).awaitTermination()
        seen.append({r.job: r.status for r in ev.monitored_jobs(spark, str(tmp_path / "out")).collect()})
    assert seen[0] == {"a": "running", "b": "queued", "c": "running", "d": "running"}
    assert seen[1] == {"a": "ready", "b": "failed", "c": "failed", "d": "running"}
    assert seen[2]["d"] == "failed" and seen[2]["e"] == "running"  # no row of d came: its timer fired
    log = spark.read.schema(schema).parquet(str(tmp_path / "log")).filter("job is not null and ts is not null") \
        .withColumn("status", F.coalesce("status", F.lit("")))
    want = ev.job_fold(log, now=F.lit(at(85)), **columns)
    assert sorted(map(tuple, ev.monitored_jobs(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_job_state_is_kept_without_python(spark, tmp_path):
    """one Python call and several messages for every job before; late rows do not count and a repeated batch changes nothing."""
    schema = "job string, ts timestamp, id bigint, status string"
    at = lambda minutes: START + timedelta(minutes=minutes)
    columns = dict(job="job", status="status", time="ts", ident="id", complete=F.lit(True), window_seconds=3600)
    out = str(tmp_path / "out")
    for part in ([("a", at(0), 1, "running"), ("b", at(100), 2, "running"), ("c", at(90), 3, "ready")],
                 [("a", at(10), 4, "ready"), ("c", at(95), 5, "running"), ("d", at(120), 6, "running")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        query = ev.monitor_jobs(stream, out, str(tmp_path / "ckpt"), delay="5 minutes", **columns)
        query.awaitTermination()
        names = {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]}
        assert names and not any("transformWithState" in n for n in names)
    want = {"a": "failed", "b": "running", "c": "ready", "d": "running"}  # the end of a came behind the watermark
    assert {r.job: r.status for r in ev.monitored_jobs(spark, out).collect()} == want
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "rows").iterdir())
    state = "job string, first bigint, end struct<at: bigint, ident: bigint, state: string>, last struct<at: bigint, ident: bigint, state: string>"
    for _ in range(2):  # a job four hours later: the other windows pass with the next batch
        micros = int((at(340) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        again = spark.createDataFrame([("e", micros, None, (micros, 7, "running"))], state)
        ev.JobTimers(spark, out, "5 minutes", 3600)(again, last + 1)
    assert {r.job: r.status for r in ev.monitored_jobs(spark, out).collect()} == {**want, "e": "running"}
    for _ in range(2):
        ev.JobTimers(spark, out, "5 minutes", 3600)(again.limit(0), last + 2)
        got = {r.job: r.status for r in ev.monitored_jobs(spark, out).collect()}
        assert got == {"a": "failed", "b": "failed", "c": "ready", "d": "failed", "e": "running"}
