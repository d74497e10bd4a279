"""Event log folds for batch and stream, and the streams around the log.

Folds compare by event time and id, never by arrival, so a replayed or
reordered stream gives the batch result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.operators.admission import MAX_BATCH_BYTES, MAX_FILES, batch_quota
from proofgrid.operators.ranking import join_back

# Terminal states and the monitoring window of a job.
TERMINAL_STAGE = ["complete", "limited", "skipped", "failed"]
TERMINAL_JOB = ["ready", "failed"]
MONITOR_SECONDS = 3600

EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("case_id", T.StringType()), T.StructField("stage", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("message", T.StringType()), T.StructField("item_count", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])


def read_log(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA, stream: bool = False, case_id: str | None = None) -> DataFrame:
    """Replay (batch) or follow (stream) the append-only log, of one case or of all."""
    reader = spark.readStream if stream else spark.read
    log = reader.schema(schema).parquet(path)
    return log if case_id is None else log.filter(F.col("case_id") == case_id)


def follow(log: DataFrame, out: str, checkpoint: str, **trigger) -> object:
    """Forward new events to an append sink; exactly once by the sink's own log."""
    return log.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append") \
        .trigger(**(trigger or {"availableNow": True})).start(out)


def distinct_events(log: DataFrame, *, key: str = "id", time: str = "created_at", delay: str | None = None) -> DataFrame:
    """One row per event id.  On a stream, ``delay`` bounds the state kept for it."""
    if log.isStreaming:
        return log.withWatermark(time, delay or "1 hour").dropDuplicatesWithinWatermark([key])
    order = F.struct(F.col(time))
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__e")).select(key, "__e.*")


def after_reset(log: DataFrame, resets: DataFrame, *, case: str, time: str, reset_at: str) -> DataFrame:
    """Only events later than the newest reset of their case."""
    last = resets.groupBy(case).agg(F.max(reset_at).alias("__reset"))
    if log.isStreaming:
        return log.join(last, case, "left").filter(F.col("__reset").isNull() | (F.col(time) > F.col("__reset"))).drop("__reset")
    return join_back(log, last, [case]).filter(F.col("__reset").isNull() | (F.col(time) > F.col("__reset"))).drop("__reset")


def stage_fold(log: DataFrame, *, case: str, stage: str, status: str, message: str, time: str, event: str,
               items: str | None = None) -> DataFrame:
    """State of every stage: first start, latest end, last status and message, last item count.

    The same aggregation serves a batch and a stream in complete or update mode.
    """
    at = F.struct(F.col(time), F.col(event))
    st = F.col(status)
    extra = [] if items is None else [F.max_by(F.col(items), F.when(F.col(items).isNotNull(), at)).alias("item_count")]
    return log.groupBy(case, stage).agg(
        F.min(F.when(st == "running", F.col(time))).alias("started_at"),
        F.max(F.when(st.isin(TERMINAL_STAGE), F.col(time))).alias("completed_at"),
        F.max_by(st, at).alias("status"), F.max_by(F.col(message), at).alias("message"), *extra)


def reset_stages(stages: DataFrame, resets: DataFrame, *, case: str, running: Column) -> DataFrame:
    """Stages after a retry request: all pending, unless the case is still running (refused)."""
    busy = stages.groupBy(case).agg(F.bool_or(running).alias("__busy"))
    asked = join_back(resets.select(case).distinct(), busy, [case])
    accepted = asked.filter(~F.coalesce("__busy", F.lit(False))).select(case, F.lit(True).alias("__ok"))
    out = stages.join(accepted, case, "left")
    return out.withColumn("status", F.when(F.col("__ok"), "pending").otherwise(F.col("status"))) \
        .withColumn("message", F.when(F.col("__ok"), "Waiting").otherwise(F.col("message"))).drop("__ok")


def job_fold(log: DataFrame, *, job: str, status: str, time: str, ident: str, complete: Column,
             now: Column | None = None, window_seconds: int = MONITOR_SECONDS) -> DataFrame:
    """State of every job; the first terminal state stays.

    ``complete`` says whether a ready row names its manifest and its scene or
    model; an incomplete one is a failure.  A job that ends, or has not ended by
    ``now``, later than the monitoring window after its first row counts as
    failed.  Rows of one time are ordered by ``ident``.
    """
    rows = log.withColumn("__s", _job_state(status, complete))
    t, order = F.col(time), F.struct(time, ident)
    ended = F.col("__s").isin(TERMINAL_JOB)
    agg = rows.groupBy(job).agg(
        F.min_by("__s", F.when(ended, order)).alias("__end"), F.min(F.when(ended, t)).alias("ended_at"),
        F.max_by("__s", order).alias("__last"), F.min(t).alias("first_seen"))
    until = F.col("ended_at") if now is None else F.coalesce("ended_at", now.cast("timestamp"))
    late = F.coalesce(until.cast("timestamp").cast("double") - F.col("first_seen").cast("timestamp").cast("double")
                      > window_seconds, F.lit(False))
    return agg.select(job, F.when(late, "failed").otherwise(F.coalesce("__end", "__last")).alias("status"), "ended_at")


def _job_state(status: str, complete: Column) -> Column:
    ready = F.when(F.coalesce(complete, F.lit(False)), "ready").otherwise("failed")
    return F.when(F.col(status) == "ready", ready).otherwise(F.col(status))


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def job_states(log: DataFrame, *, job: str, status: str, time: str, ident: str, complete: Column, delay: str) -> DataFrame:
    """(job, first, end, last), the keyed state of every job that changed; times in microseconds.

    First time, first terminal row and last row.  The state has no expiry, because a terminal state stays whatever comes
    later; the duplicates' state before it ends with the watermark and drops the rows behind it.
    """
    named = F.col(job).isNotNull() & F.col(time).isNotNull() & F.col(ident).isNotNull()
    rows = log.filter(named).select(
        F.col(job).alias("job"), F.col(time).cast("timestamp").alias("ts"), F.col(ident).alias("ident"),
        F.coalesce(_job_state(status, complete), F.lit("")).alias("state")).withWatermark("ts", delay) \
        .dropDuplicates(["ts", "job", "ident", "state"])
    row = F.struct(F.unix_micros("ts").alias("at"), "ident", "state")
    return rows.groupBy("job").agg(F.min(F.unix_micros("ts")).alias("first"),
                                   F.min(F.when(F.col("state").isin(TERMINAL_JOB), row)).alias("end"), F.max(row).alias("last"))


class JobTimers:
    """The sink of ``job_states``, with a timer at the end of every open job's monitoring window.

    Each micro-batch writes the jobs that changed and those whose timer fired into a folder of its own, which a repeated
    batch replaces.  Its clock is the watermark, the newest time of the batches before less the delay.  Timers that have not
    fired lie beside it, in one of two folders in turn, so a repeated batch finds those of the batch before; a job has one as
    long as it is open and its window lies ahead of the watermark, so they are few however many jobs there have been.
    """

    def __init__(self, spark: SparkSession, out: str, delay: str, window_seconds: int):
        self.out, self.window = out, window_seconds * 1_000_000
        self.delay = spark.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + interval '{delay}')")).first()[0]

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, here = batch.sparkSession, f"{self.out}/rows/part={number}"
        newest, timers = None, None
        if number:
            newest = spark.read.parquet(self._kept("clock", number - 1)).first().newest
            timers = spark.read.parquet(self._kept("timers", number - 1))
        clock = F.lit(None if newest is None else (newest // 1000 - self.delay) * 1000).cast("bigint")
        due = F.coalesce(F.col("first") + self.window < clock, F.lit(False))
        expired = F.col("end").isNull() & due
        late = F.when(F.col("end").isNull(), due).otherwise(F.col("end.at") - F.col("first") > self.window)
        batch.select("job", F.when(late, "failed").otherwise(F.coalesce("end.state", "last.state")).alias("status"),
                     F.col("end.at").alias("ended"), expired.alias("expired"), "first", F.col("last.at").alias("newest"),
                     F.lit(number).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{here}/by=row")
        changed = spark.read.schema(self._schema(batch)).parquet(f"{here}/by=row")
        still = changed.filter("ended is null and not expired").select("job", "first")
        if timers is not None:
            left = timers.join(changed.select("job"), "job", "left_anti")
            left.filter(due).select("job", F.lit("failed").alias("status"), F.lit(None).cast("bigint").alias("ended"), F.lit(True).alias("expired"),
                                    "first", F.lit(None).cast("bigint").alias("newest"), F.lit(number).cast("bigint").alias("batch")) \
                .write.mode("overwrite").parquet(f"{here}/by=timer")
            still = still.unionByName(left.filter(~due).select("job", "first"))
        still.write.mode("overwrite").parquet(self._kept("timers", number))
        changed.agg(F.greatest(F.max("newest"), F.lit(newest).cast("bigint")).alias("newest")) \
            .write.mode("overwrite").parquet(self._kept("clock", number))

    def _kept(self, name: str, number: int) -> str:
        return f"{self.out}/{name}/turn={number % 2}"

    @staticmethod
    def _schema(batch: DataFrame) -> T.StructType:
        return T.StructType([batch.schema["job"], *(T.StructField(n, t) for n, t in (
            ("status", T.StringType()), ("ended", T.LongType()), ("expired", T.BooleanType()), ("first", T.LongType()),
            ("newest", T.LongType()), ("batch", T.LongType())))])


def monitor_jobs(log: DataFrame, out: str, checkpoint: str, *, job: str, status: str, time: str, ident: str, complete: Column,
                 delay: str = "10 minutes", window_seconds: int = MONITOR_SECONDS, **trigger) -> object:
    """T03 on a stream: ``job_fold`` whose clock is the watermark (newest time seen less ``delay``).

    A job without an end when the watermark passes its window fails by a timer, without a row of its own; ``monitored_jobs``
    reads the newest state.  Rows without a job, a time or an id, and rows behind the watermark, do not count.
    """
    spark = log.sparkSession
    states = job_states(log, job=job, status=status, time=time, ident=ident, complete=complete, delay=delay)
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:  # a stream takes the settings that hold when it starts
        return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
            .foreachBatch(JobTimers(spark, out, delay, window_seconds)).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def monitored_jobs(spark: SparkSession, out: str, job: str = "job") -> DataFrame:
    """(job, status, ended_at), the newest state of every job that ``monitor_jobs`` wrote."""
    newest = spark.read.parquet(f"{out}/rows").groupBy("job").agg(
        F.max_by(F.struct("status", "ended"), F.struct("batch", "expired")).alias("s"))
    return newest.select(F.col("job").alias(job), "s.status", F.timestamp_micros("s.ended").alias("ended_at"))


def stage_latency(stages: DataFrame) -> DataFrame:
    """Seconds from first start to latest end of each stage."""
    seconds = F.col("completed_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")
    return stages.withColumn("seconds", seconds)


def ingest_metrics(files: DataFrame, out: str, checkpoint: str, *, batch: str, size: str, max_files: int = MAX_FILES,
                   max_bytes: int = MAX_BATCH_BYTES) -> object:
    """Running file and byte totals per upload batch, judged against its quota after each micro-batch."""
    totals = files.groupBy(batch).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    judged = totals.withColumn("accepted", (F.col("files") <= max_files) & (F.col("bytes") <= max_bytes))
    return drain(judged, out, checkpoint)


def drain(df: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> object:
    """Run a stateful stream over everything available; each trigger replaces the full result at ``out``."""
    def write(batch: DataFrame, _: int) -> None:
        (batch if transform is None else transform(batch)).write.mode("overwrite").parquet(out)

    return df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write) \
        .trigger(availableNow=True).start()


def quota_batch(files: DataFrame, **kw) -> DataFrame:
    """T04 on a table: the same totals in one pass."""
    return batch_quota(files, **kw)
