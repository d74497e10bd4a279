"""WARC archives: writing with revisit records, and reading by boundary-chain verification (operator 4).

*Writing.*  One record per row.  Of rows with equal payloads the one with the smallest id is a ``response``, the
others are ``revisit`` records without a payload that refer to it.  Spark's text writer puts the records one after
the other into files, so a lost task is simply written again.

*Reading.*  The archive is read in splits, cut at every occurrence of the record magic, also at those inside
payloads.  Each task emits candidate records with their place in the split, and the distance to the successor that
their own header claims; the bytes a split yields place the splits in the file, and so the candidates.  Pointer
jumping then starts at the first byte of every file: in each round the reached set follows all pointers, and the
pointers are joined with themselves, so a file of n records takes about log2(n) rounds.  Only reached candidates are
records; magic inside a payload is never reached.  Payloads that hold the magic are put together again from their
pieces.

Defined results: a null payload is empty; a null URL is written as empty; rows with a null id are responses of their
own unless an equal payload has an id; a chain ends at bytes that are no record.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import in_arrow, stored

MAGIC = "WARC/1.1\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:page:"
BUCKET = 1 << 20
HEADER = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
HTTP_END = b"\r\n\r\n"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: every five hex digits are four letters."""
    letters = []
    for group in range(8):
        n = F.conv(F.substring(F.sha1(data), 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1))
                    for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _first_copies(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(id, key, refers_to) of the rows that repeat the payload of a row with a smaller id; an id may have several."""
    keyed = rows.select("id", "n_bytes", "key").filter(F.col("n_bytes") >= least_bytes)
    groups = keyed.groupBy("key", "n_bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")) \
        .filter("c > 1")
    return keyed.join(groups, ["key", "n_bytes"]).filter(~F.col("id").eqNullSafe(F.col("first"))) \
        .select("id", "key", F.col("first").alias("refers_to"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *,
               least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` below ``path``; payloads are strings, stored in UTF-8."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "")
                        .alias("url"), payload.alias("payload"), F.octet_length(payload).alias("n_bytes"),
                        F.sha2(payload, 256).alias("key"))
    # Stored first: its size decides whether it is sent to the tasks or joined by shuffle.
    copies = stored(_first_copies(rows, least_bytes).distinct(), "revisits")
    marked = rows.join(copies, rows["id"].eqNullSafe(copies["id"]) & (rows["key"] == copies["key"]), "left").select(rows["*"], "refers_to")
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    refers = F.col("refers_to").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(refers.isNull(), F.col("payload")).otherwise(F.lit("")))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(refers.isNull(), F.lit("response")).otherwise(F.lit("revisit")),
        F.lit(f"\r\nWARC-Record-ID: <{URN}"), text_id, F.lit(">\r\nWARC-Target-URI: "), F.col("url"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), sha1_base32(F.col("payload")),
        F.when(refers.isNotNull(), F.concat(
            F.lit("\r\nWARC-Profile: http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
                  f"\r\nWARC-Refers-To: <{URN}"), refers, F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    # The writer adds the last byte of each record, a line feed.
    marked.select(F.concat(header, block, F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").text(path)


def parse(raw: bytes) -> tuple[int | None, str, str, str, str, bytes | None]:
    """A record behind its magic: distance to its successor, type, id, reference, digest, payload if it is complete."""
    end = raw.find(HTTP_END)
    if end < 0:
        return None, "", "", "", "", None
    fields = {k.lower(): v for k, v in HEADER.findall(raw[:end + 2])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None, "", "", "", "", None
    start, size = end + 4, int(length)
    named = [fields.get(k, b"").decode("utf-8", "replace") for k in
             (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-payload-digest")]
    block = raw[start:start + size] if len(raw) >= start + size else None
    if block is not None and fields.get(b"content-type", b"").startswith(b"application/http"):
        block = block[block.find(HTTP_END) + 4:]
    return len(MAGIC) + start + size + 4, *named, block


SEGMENT = ("file bigint, split bigint, at bigint, size bigint, next bigint, kind string, id string, refers_to string, "
           "digest string, body binary")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                      F.col("value").cast("binary").alias("raw"))


def _walk(batches):
    """Rows of a task in file order: yields (file, split, place in the split, raw) per row."""
    here, at = None, 0
    for batch in batches:
        for file, split, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if here != (file, split):
                here, at = (file, split), 0
            yield file, split, at, raw
            at += len(raw) + len(MAGIC)


def candidates(spark: SparkSession, path: str, derive: dict[str, Column]) -> DataFrame:
    """Every piece behind a magic, with what it would be as a record; ``derive`` is computed from ``body``, its payload."""
    def run(batches):
        rows, held = [], 0
        names = [c.split()[0] for c in SEGMENT.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] * 4 + [pa.binary()]
        for file, split, at, raw in _walk(batches):
            rows.append((file, split, at, len(raw), *parse(raw)))
            held += len(raw)
            if held > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    found = in_arrow(_segments(spark, path), run, SEGMENT)
    return found.withColumn("complete", F.col("body").isNotNull()).withColumns(derive).drop("body")


def reachable(pointers: DataFrame) -> DataFrame:
    """(file, start) of the records on the chain from the first byte of each file; pointers: (file, start, next)."""
    jump = stored(pointers, "pointers")
    reached = jump.filter("start = 0").select("file", "start")
    if reached.isEmpty():
        return reached
    while True:
        steps = jump.select("file", "start", F.col("next").alias("to"))
        new = stored(reached.join(steps, ["file", "start"]).select("file", F.col("to").alias("start")), "reached")
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        further = jump.select("file", F.col("start").alias("to"), "next")
        jump = stored(steps.join(further, ["file", "to"]).select("file", "start", "next"), "pointers")


def read_warc(spark: SparkSession, path: str, derive: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(file, start, kind, id, refers_to, digest, complete and the columns of ``derive``) per record.

    ``derive`` maps names to functions of the payload (use ``lambda p: p`` for the bytes); they are computed where the
    payload is read.  A revisit has the empty payload it is stored with.
    """
    computed = {name: fn(F.col("body")) for name, fn in derive.items()}
    found = stored(candidates(spark, path, computed), "candidates")
    splits = found.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")
    placed = found.join(splits.select("file", "split", before.alias("base")), ["file", "split"]) \
        .withColumn("start", F.col("base") + F.col("at") - len(MAGIC)).filter("start >= 0") \
        .withColumn("next", F.col("start") + F.col("next")).drop("base")
    placed = stored(placed, "placed")
    # a pointer to the end of the file, or to no candidate, ends the chain
    reached = reachable(placed.filter("next is not null").select("file", "start", "next"))
    records = placed.filter("next is not null").join(reached, ["file", "start"])
    broken = stored(records.filter("not complete").select("file", "start", "next"), "broken")
    out = ["file", "start", "kind", "id", "refers_to", "digest", *derive]
    if broken.isEmpty():
        return records.select(*out)
    whole = _put_together(spark, path, placed, broken).withColumns(computed)
    return records.filter("complete").select(*out).unionByName(whole.select(*out))


def _put_together(spark: SparkSession, path: str, placed: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their pieces, joined by place, in order."""
    def locate(batches):
        for file, split, at, raw in _walk(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split]), pa.array([at]), pa.array([raw])],
                                             names=["file", "split", "at", "raw"])

    cell = F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("next") / BUCKET)))
    wanted = broken.select("file", F.col("start").alias("record"), "next", cell.alias("cell"))
    pieces = placed.select("file", "split", "at", "start", F.floor(F.col("start") / BUCKET).alias("cell")) \
        .join(wanted, ["file", "cell"]).filter("start >= record and start < next").select("file", "split", "at", "record",
                                                                                        "start")
    raw = in_arrow(_segments(spark, path), locate, "file bigint, split bigint, at bigint, raw binary")
    groups = raw.join(pieces, ["file", "split", "at"]).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("start", "raw"))).alias("parts"))  # at most one record's bytes

    def join(batches):
        for batch in batches:
            for file, record, parts in zip(*(c.to_pylist() for c in batch.columns)):
                _, kind, name, refers, digest, payload = parse(MAGIC.encode().join(p["raw"] for p in parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([record]), *[pa.array([x], pa.string())
                                                             for x in (kind, name, refers, digest)],
                     pa.array([payload], pa.binary())],
                    names=["file", "start", "kind", "id", "refers_to", "digest", "body"])

    return in_arrow(groups, join, "file bigint, start bigint, kind string, id string, refers_to string, digest string, "
                                   "body binary")


def urn_id(urn: Column, kind: str) -> Column:
    """The id of a record name; null where it is empty."""
    return F.regexp_extract(urn, f"<{URN}(.*)>", 1).try_cast(kind)


def with_referred(records: DataFrame, columns: list[str]) -> DataFrame:
    """Revisits get the payload columns of the record they refer to: that with their digest, if an id names several."""
    named, filled = records.filter("kind = 'response' and id <> ''"), records.filter("kind = 'revisit'")
    for i, keys in enumerate((["id", "digest"], ["id"])):
        own = named.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[F.first(c).alias(f"__{i}_{c}") for c in columns])
        same = F.col("refers_to") == F.col("__id")
        filled = filled.join(own, same & (F.col("digest") == F.col("__digest")) if "digest" in keys else same, "left") \
            .drop(*[f"__{k}" for k in keys])
    filled = filled.withColumns({c: F.coalesce(f"__0_{c}", f"__1_{c}", c) for c in columns}).select(records.columns)
    return records.filter("kind <> 'revisit'").unionByName(filled)
