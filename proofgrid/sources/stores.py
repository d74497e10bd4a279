"""Entity logs, documents, files and exports.

Writers append or overwrite by partition; readers push key filters to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.functions.text import natural_key
from proofgrid.operators.ranking import number_rows
from proofgrid.session import stored

# Fixed values of the artifact checks.
RECORD_BYTES = 32
MIN_RECORDS = 1000
JOINT_DEFAULT_CONFIDENCE = 0.55
PLACEMENTS = ["joint_camera_calibrated_by_metric_core", "measured_feature_and_sharp_metric"]
MEASURED_PLACEMENT = "measured_feature_and_sharp_metric"

POSE_SCHEMA = ("array<struct<frame:double, position:array<double>, rotationWxyz:array<double>, scale:double, "
               "placement:string>>")
JOINT_SCHEMA = "array<struct<frame:double, confidence:double>>"


def scan_entities(df: DataFrame, schema: str, *, payload: str = "payload", where: Column | None = None) -> DataFrame:
    """Typed rows from JSON payloads; key filters go below the parse."""
    rows = df if where is None else df.filter(where)
    return rows.withColumn("__e", F.from_json(payload, schema)).select(
        *[c for c in df.columns if c != payload], "__e.*")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of one key, or no row; the predicate reaches the Parquet scan."""
    return df.filter(F.col(key) == F.lit(value))


def latest_entities(log: DataFrame, *, key: str, seq: list[str], payload: list[str], created: str = "created_at",
                    stamp: str | None = None) -> DataFrame:
    """Current state of an upsert log: newest payload, first creation time."""
    order = F.struct(*seq)
    picks = [F.max_by(F.col(c), order).alias(c) for c in payload]
    extra = [F.max_by(F.col(stamp), order).alias("updated_at")] if stamp else []
    return log.groupBy(key).agg(F.min_by(F.col(created), order).alias("created_at"), *extra, *picks)


def cascade_delete(children: dict[str, DataFrame], tombstones: DataFrame, *, case: str) -> dict[str, DataFrame]:
    """Every child table without the rows of deleted cases."""
    gone = tombstones.select(case).distinct()
    return {name: df.join(gone, case, "left_anti") for name, df in children.items()}


def workspace_pages(cases: DataFrame, children: dict[str, tuple[DataFrame, list[Column], Column | None]], *,
                    case: str, page_size: int = 1000) -> DataFrame:
    """One nested document per case, its child lists in creation order.

    A list longer than ``page_size`` runs on in further pages of the document,
    so no row and no task holds an unbounded case.  Each child comes with its
    order and, for cases that may be huge, a slice expression of that order.
    """
    pages = None
    for name, (df, order, slice_by) in children.items():
        ranked = number_rows(df, [case], order, "__rn", slice_by)
        item = F.struct(F.col("__rn").alias("seq"), *[c for c in df.columns if c != case])
        lists = ranked.groupBy(case, F.floor((F.col("__rn") - 1) / page_size).cast("bigint").alias("page")).agg(
            F.array_sort(F.collect_list(item)).alias(name))
        pages = lists if pages is None else pages.join(lists, [case, "page"], "full")
    return cases.join(pages, case, "left").withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))


def append_events(events: DataFrame, path: str, batch: int | str, *, ident: str = "id", time: str = "created_at") -> None:
    """Insert-only event log; an event id is inserted once, and a batch that is delivered again replaces itself.

    Each batch has its own folder.  What other batches hold already is left out by a join on the id, so late repetitions
    of an event change nothing; within a batch the earliest row of an id stays.
    """
    spark = events.sparkSession
    rest = [c for c in events.columns if c != ident]
    once = events.groupBy(ident).agg(F.min(F.struct(time, *[c for c in rest if c != time])).alias("__e")).select(ident, "__e.*")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.schema(once.schema.add("batch", "string")).parquet(path).filter(F.col("batch") != str(batch))
        once = once.join(known.select(ident), ident, "left_anti")
    once.sortWithinPartitions(time, ident).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_stream(events: DataFrame, path: str, checkpoint: str, *, ident: str = "id", time: str = "created_at") -> object:
    """A stream into the log; a micro-batch that is tried again gives the same log."""
    return events.writeStream.foreachBatch(lambda df, n: append_events(df, path, n, ident=ident, time=time)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_events(spark: SparkSession, path: str, schema: T.StructType, *, case: str = "case_id", ident: str = "id",
                  time: str = "created_at") -> DataFrame:
    """The log with each event's ``position`` in its case, in creation order; days are the slices of a long case."""
    log = spark.read.schema(schema).parquet(path)
    return number_rows(log, [case], [F.col(time), F.col(ident)], "position", F.to_date(time))


def replay_then_tail(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One stream that first replays the log and then follows what is appended."""
    return spark.readStream.schema(schema).parquet(f"{path}/batch=*")


# Media types by file ending.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "pdf": "application/pdf",
               "json": "application/json", "txt": "text/plain"}


FILES_A_TASK = 100  # written by one task
SMALL_FILES = {"spark.sql.files.openCostInBytes": "16KB",  # a task reads many
               "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64"}  # and lists many folders


def write_files(rows: DataFrame, path: str, *, name: str) -> None:
    """One text file, in a folder of its own, for all lines (column ``value``) of a name.

    Tasks hold some ``FILES_A_TASK`` names and move their files themselves, else all moves wait for the driver; a repeated
    task replaces its own files.
    """
    tasks = max(1, -(-rows.count() // FILES_A_TASK))
    rows.repartition(tasks, name).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(name).text(path)


def ingest_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file below ``path`` with the digest and size of its exact bytes, its type and its arrival order.

    Files of one modification time arrive in path order; the source passes over files without a byte.  A file's content is in its row only while it is digested.
    Files are read once; a small one does not count as megabytes, so a task lists and reads many.
    """
    before = {k: spark.conf.get(k) for k in SMALL_FILES}
    for k, v in SMALL_FILES.items():
        spark.conf.set(k, v)
    try:
        rows = stored(_file_facts(spark, path, pattern), "files")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return number_rows(rows, [], [F.col("modificationTime"), F.col("path")], "arrival", F.date_trunc("minute", "modificationTime"))


def _file_facts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", pattern).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])[ending], F.lit("application/octet-stream"))
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"),
                        F.col("length").alias("byte_size"), kind.alias("media_type"), "modificationTime")


def fingerprint(content: Column) -> Column:
    """SHA-256 and byte size of a binary or text column."""
    raw = content.cast("binary")
    return F.struct(F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("bigint").alias("byte_size"))


MANIFEST_SCHEMA = ("datasetId string, frames array<struct<file:string, sha256:string, roomId:string, "
                   "expectedRegistered:boolean>>, thresholds map<string,double>")


def manifest_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of acceptance manifests, one document a line, with their position."""
    raw = spark.read.schema(MANIFEST_SCHEMA).json(path)
    return raw.select(F.col("datasetId").alias("dataset_id"), F.posexplode("frames").alias("index", "f")).select(
        "dataset_id", "index", "f.*")


def missing_inputs(frames: DataFrame, files: DataFrame, *, name: str) -> DataFrame:
    """Every frame whose file is not there, all at once."""
    return frames.join(files.select(name).distinct(), name, "left_anti")


def scan_reports(df: DataFrame, schema: str, *, text: str) -> DataFrame:
    """Parsed reports; bad or missing JSON gives NULL, never an error."""
    return df.withColumn("report", F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _tuple_ok(values: Column, n: int) -> Column:
    return F.coalesce((F.size(values) == n) & F.forall(values, _finite), F.lit(False))


def _whole(x: Column) -> Column:
    return F.coalesce(_finite(x) & (x >= 0) & (x == F.floor(x)), F.lit(False))


def flatten_poses(df: DataFrame, *, artifact: str, evidence_ids: str, poses: str, joint: str,
                  registration: str) -> DataFrame:
    """Valid camera poses of every report, with placement and confidence."""
    joint_map = F.map_from_entries(F.transform(
        F.filter(F.coalesce(F.col(joint), F.array().cast(JOINT_SCHEMA)),
                 lambda j: _whole(j["frame"]) & _finite(j["confidence"])),
        lambda j: F.struct(j["frame"].cast("int"), j["confidence"])))
    rows = df.select(artifact, evidence_ids, registration, joint_map.alias("__j"), F.explode(poses).alias("__p"))
    frame = F.col("__p.frame").cast("int")
    rows = rows.filter(_whole(F.col("__p.frame")) & _tuple_ok(F.col("__p.position"), 3)
                       & _tuple_ok(F.col("__p.rotationWxyz"), 4))
    rows = rows.withColumn("evidence_id", F.get(F.col(evidence_ids), frame)).filter("evidence_id <> ''")
    placement = F.when(F.col("__p.placement").isin(PLACEMENTS), F.col("__p.placement")).otherwise("anchor")
    confidence = F.try_element_at(F.col("__j"), frame)
    measured = F.greatest(F.coalesce(F.col(registration), F.lit(0.5)), F.coalesce(confidence, F.lit(0.0)))
    scale = F.col("__p.scale")
    return rows.select(
        artifact, "evidence_id", frame.alias("source_index"),
        *[F.col("__p.position")[i].alias(n) for i, n in enumerate(("px", "py", "pz"))],
        *[F.col("__p.rotationWxyz")[i].alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))],
        F.when(_finite(scale) & (scale > 0), scale).otherwise(1.0).alias("scale"), placement.alias("placement"),
        F.when(placement == MEASURED_PLACEMENT, measured)
        .otherwise(F.coalesce(confidence, F.lit(JOINT_DEFAULT_CONFIDENCE))).alias("confidence_score"))


def nonnegative(x: Column) -> Column:
    """The number when finite and not negative, else NULL."""
    return F.when(_finite(x) & (x >= 0), x)


def unit_number(x: Column) -> Column:
    return F.when(_finite(x) & x.between(0, 1), x)


def reconstruction_quality(df: DataFrame, *, mode: str, connected: str, frames: str, evidence_ids: str,
                           disconnected: str, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Registered ratio, missing bridges and cleaned metrics of each artifact.

    ``metrics`` maps output names to (column, 'nonnegative' | 'unit').
    """
    single = F.col(mode) != "multi_image"
    total = F.coalesce(F.col(frames), F.size(evidence_ids))
    ratio = F.coalesce(F.col(connected), F.lit(1)) / F.greatest(F.lit(1), total)
    missing = F.array_compact(F.transform(
        F.filter(F.coalesce(F.col(disconnected), F.array().cast("array<double>")), _whole),
        lambda i: F.get(F.col(evidence_ids), i.cast("int"))))
    clean = {"nonnegative": nonnegative, "unit": unit_number}
    return df.select(
        "*", F.when(single, F.lit(1.0)).otherwise(ratio).alias("registered_ratio"),
        F.when(single, F.array().cast("array<string>")).otherwise(missing).alias("missing_bridge_ids"),
        *[F.when(~single, clean[kind](F.col(col))).alias(name) for name, (col, kind) in metrics.items()])


def audit_records(points: DataFrame, files: DataFrame, *, scene: str, size: str,
                  minimum: int = MIN_RECORDS) -> DataFrame:
    """Compiled size must be 32 bytes per row, and a scene needs enough rows."""
    counts = points.groupBy(scene).agg(F.count(F.lit(1)).alias("rows"))
    both = files.join(counts, scene, "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
    return both.withColumn("verdict", F.when(F.col(size) != F.col("rows") * RECORD_BYTES, "size_mismatch")
                           .when(F.col("rows") < minimum, "too_few").otherwise("ok"))


def manifest_json(*fields: Column) -> Column:
    """Artifact manifest as one JSON text per artifact."""
    return F.to_json(F.struct(*fields))


def write_manifests(df: DataFrame, path: str, attempt: str, *, case: str = "case_id", document: str = "document",
                    shards: int = 64) -> None:
    """JSON documents by case, and the attempt's manifest last.

    Cases share ``shards`` folders, so their number is no number of files.  The manifest names every case with the
    count, size and digest of its documents; an attempt without one does not exist for readers.
    """
    folder = f"{path}/documents/attempt={attempt}"
    shard = F.pmod(F.xxhash64(case), F.lit(shards))
    df.select(F.col(case).alias("case_key"), F.col(document).alias("document"), shard.alias("shard")) \
        .repartition("shard").sortWithinPartitions("shard", "case_key").write.mode("overwrite").partitionBy("shard").json(folder)
    written = df.sparkSession.read.schema(df.select(F.col(case).alias("case_key"), F.col(document).alias("document")).schema).json(folder)
    _facts(written).withColumn("committed_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/manifests/attempt={attempt}")


def _facts(written: DataFrame) -> DataFrame:
    """Count, size and an order-free digest of the documents of every case."""
    return written.groupBy("case_key").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("document")).alias("bytes"),
        F.bit_xor(F.xxhash64("document")).alias("digest"))


def read_manifests(spark: SparkSession, path: str, case_type: str = "bigint") -> DataFrame:
    """(case_key, document) of each case's latest committed attempt, if its documents are those committed.

    Attempts that never committed, or whose documents were damaged since, are not read.
    """
    commits = spark.read.schema(f"case_key {case_type}, documents bigint, bytes bigint, digest bigint, committed_at timestamp, "
                                "attempt string").parquet(f"{path}/manifests")
    latest = commits.groupBy("case_key").agg(F.max_by(
        F.struct("attempt", "documents", "bytes", "digest"), F.struct("committed_at", "attempt")).alias("m")).select("case_key", "m.*")
    found = spark.read.schema(f"case_key {case_type}, document string, shard int, attempt string").json(f"{path}/documents")
    held = found.join(latest.select("case_key", "attempt"), ["case_key", "attempt"])
    whole = _facts(held).join(latest, ["case_key", "documents", "bytes", "digest"], "left_semi").select("case_key")
    return held.join(whole, "case_key", "left_semi").select("case_key", "document")


def plan_model(floors: DataFrame, *, case: str, floor: str, members: list[str]) -> DataFrame:
    """One model row per case: floors in order, each already aggregated, with totals.

    Storeys of one building are bounded; walls and rooms stay in their own tables.
    """
    item = F.struct(F.col(floor), *[F.col(m) for m in members])
    return floors.groupBy(case).agg(
        F.array_sort(F.collect_list(item)).alias("floors"), F.count(F.lit(1)).alias("floor_count"),
        *[F.sum(m).alias(f"{m}_total") for m in members])


def briefing_header(hazards: DataFrame, routes: DataFrame, *, case: str, review: str) -> DataFrame:
    """Counts per case; final when there are routes and none is pending."""
    both = hazards.select(case, review, F.lit(0).alias("__route")).unionByName(
        routes.select(case, review, F.lit(1).alias("__route")))
    route = F.col("__route") == 1
    return both.groupBy(case).agg(
        (F.count_if(route) > 0).alias("__any"), F.count_if(route & (F.col(review) == "pending")).alias("__open"),
        F.count_if(~route & (F.col(review) == "confirmed")).alias("confirmed_hazards"),
        F.count_if(route & (F.col(review) == "confirmed")).alias("confirmed_routes"),
        F.count_if(F.col(review) == "pending").alias("unresolved"),
    ).withColumn("final", F.col("__any") & (F.col("__open") == 0)).drop("__any", "__open")


def briefing_items(hazards: DataFrame, routes: DataFrame, *, case: str, item: str, review: str) -> DataFrame:
    """Confirmed and unresolved ids as rows, hazards before routes."""
    def part(df, kind, rank):
        return df.select(case, F.col(item).alias("item_id"), F.lit(kind).alias("kind"), F.lit(rank).alias("kind_rank"),
                         F.when(F.col(review) == "confirmed", "confirmed").when(F.col(review) == "pending", "unresolved")
                         .alias("section"))

    return part(hazards, "hazard", 0).unionByName(part(routes, "route", 1)).filter("section is not null")


def geojson_point(properties: Column, lon: Column, lat: Column) -> Column:
    """A point feature; NULL without a location."""
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")))
    return F.when(lon.isNotNull() & lat.isNotNull(), feature)


def geojson_polygon(properties: Column, ring: Column) -> Column:
    """A footprint feature; NULL without a footprint."""
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")))
    return F.when(ring.isNotNull(), feature)


def natural_order(df: DataFrame, *, keys: list[str], name: str, rank: str = "rank") -> DataFrame:
    """Position of each file of a batch in natural name order.

    A prefix never sorts after the longer key, so key prefixes are the slices
    over which a huge batch is spread.
    """
    keyed = df.withColumn("__k", natural_key(F.col(name)))
    return number_rows(keyed, keys, [F.col("__k"), F.col(name)], rank, F.substring("__k", 1, 28)).drop("__k")


