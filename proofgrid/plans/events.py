"""Event-log folds on ``events``: a user is a case, the type is a stage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proofgrid.operators.admission import batch_quota
from proofgrid.plans.registry import query
from proofgrid.session import ensure_checkpoint_dir
from proofgrid.streaming import events as ev

STATUS = "case event_id % 4 when 0 then 'running' when 1 then 'complete' when 2 then 'failed' else 'pending' end"


def shaped(df):
    k = F.col("event_id") % 4
    status = F.when(k == 0, "running").when(k == 1, "complete").when(k == 2, "failed").otherwise("pending")
    return df.select("user_id", F.col("event_type").alias("stage"), status.alias("status"), F.col("props").alias("message"), "ts", "event_id",
                     F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("items"))


def fold(df):
    return ev.stage_fold(df, case="user_id", stage="stage", status="status", message="message", time="ts", event="event_id", items="items")


def stream_of(t, name="events"):
    """The table's file as a stream; the glob keeps the source a folder scan."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def scratch(t):
    """A fresh folder under the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


FOLD = f"""with s as (select user_id, event_type stage, {STATUS} status, props message, ts, event_id, case when event_id % 3 = 0 then event_id end items from events),
    f as (select user_id, stage, min(ts) filter (status = 'running') started_at, max(ts) filter (status in ('complete', 'failed')) completed_at, arg_max(status, (ts, event_id)) status, arg_max(message, (ts, event_id)) message,
      arg_max(items, (ts, event_id)) filter (items is not null) item_count from s group by all)"""


@query("t01_replayed_log", "select event_id, user_id, event_type from events")
def t01(t):
    """The log followed by a stream into an append sink, then read back."""
    folder = scratch(t)
    log = stream_of(t).select("event_id", "user_id", "event_type")
    ev.follow(log, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    return t.spark.read.schema(log.schema).parquet(f"{folder}/out")


@query("t02_stage_fold", FOLD + " select user_id, stage, started_at, completed_at, status, message, item_count from f")
def t02(t):
    return fold(shaped(t.events))


@query("t02_stage_fold_stream", FOLD + " select user_id, stage, started_at, completed_at, status, message, item_count from f")
def t02_stream(t):
    """The same fold drained from a stream."""
    folder = scratch(t)
    state = fold(shaped(stream_of(t)))
    ev.drain(state, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    return t.spark.read.schema(state.schema).parquet(f"{folder}/out")


def job_sql(clock):
    return f"""
    with s as (select concat(user_id, '/', strftime(ts, '%Y-%m-%d-%H')) as job, ts, event_id, case event_type when 'purchase' then case when event_id % 3 = 0 then 'ready' else 'failed' end when 'error' then case when event_id % 5 = 0 then 'failed' else 'running' end else 'running' end st,
        {clock} as clock from events),
    f as (select job, clock, arg_min(st, (ts, event_id)) filter (st in ('ready', 'failed')) e, min(ts) filter (st in ('ready', 'failed')) ended_at, arg_max(st, (ts, event_id)) l, min(ts) f from s group by all)
    select job, case when epoch(coalesce(ended_at, clock)) - epoch(f) > 1800 then 'failed' else coalesce(e, l) end as status, ended_at from f"""


def job_log(events):
    k = F.col("event_type")
    status = F.when(k == "purchase", "ready").when((k == "error") & (F.col("event_id") % 5 == 0), "failed").otherwise("running")
    job = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd-HH"))
    return events.select(job.alias("job"), "ts", "event_id", status.alias("status"))


def job_columns():
    return dict(job="job", status="status", time="ts", ident="event_id", complete=F.col("event_id") % 3 == 0, window_seconds=1800)


@query("t03_job_fold", job_sql("cast('2024-01-15 00:30:00' as timestamp)"))
def t03(t):
    return ev.job_fold(job_log(t.events), now=F.lit("2024-01-15 00:30:00"), **job_columns())


@query("t03_job_monitor_stream", job_sql("(select max(ts) from events) - interval 10 minutes"))
def t03_stream(t):
    """The same fold as a stream: jobs without an end fail by a timer when the watermark passes their window."""
    folder = scratch(t)
    ev.monitor_jobs(job_log(stream_of(t)), f"{folder}/out", f"{folder}/ckpt", delay="10 minutes", **job_columns()).awaitTermination()
    return ev.monitored_jobs(t.spark, f"{folder}/out").withColumn("ended_at", F.col("ended_at").cast(t.events.schema["ts"].dataType))


@query("t04_ingest_totals", "select user_id, count(*) as files, round(sum(value), 4) as bytes, count(*) <= 65 and sum(value) <= 1400 as accepted from events group by user_id")
def t04(t):
    out = batch_quota(t.events, batch="user_id", size="value", max_files=65, max_bytes=1400)
    return out.select("user_id", "files", F.round("bytes", 4).alias("bytes"), "accepted")


@query("t05_distinct_events", "select event_id % 5000 as id, min(ts) as ts from events group by 1")
def t05(t):
    return ev.distinct_events(t.events.select((F.col("event_id") % 5000).alias("id"), "ts"), key="id", time="ts")


@query("t06_stage_latency", FOLD + " select user_id, stage, round(epoch(completed_at) - epoch(started_at), 3) as seconds from f")
def t06(t):
    return ev.stage_latency(fold(shaped(t.events))).select("user_id", "stage", F.round("seconds", 3).alias("seconds"))


@query("t07_reset_fold", f"""
    with r as (select user_id, max(ts) reset_at from events where event_type = 'signup' and value > 60 group by 1)
    select e.user_id, e.event_type as stage, arg_max({STATUS}, (ts, event_id)) as status, count(*) as events from events e left join r on r.user_id = e.user_id where reset_at is null or ts > reset_at group by all""")
def t07(t):
    resets = t.events.filter("event_type = 'signup' and value > 60").select("user_id", F.col("ts").alias("reset_at"))
    kept = ev.after_reset(shaped(t.events), resets, case="user_id", time="ts", reset_at="reset_at")
    counts = kept.groupBy("user_id", "stage").agg(F.count(F.lit(1)).alias("events"))
    return fold(kept).join(counts, ["user_id", "stage"]).select("user_id", "stage", "status", "events")


@query("t07_retry_stages", FOLD + """, b as (select user_id, bool_or(status = 'running') busy from f group by 1)
    select f.user_id, stage, case when f.user_id % 2 = 0 and not busy then 'pending' else status end as status from f join b using (user_id)""")
def t07_retry(t):
    stages = fold(shaped(t.events))
    asked = t.events.filter("user_id % 2 = 0").select("user_id")
    return ev.reset_stages(stages, asked, case="user_id", running=F.col("status") == "running").select("user_id", "stage", "status")
