"""Exact deduplication by stateful streaming over digests (operator 3); DataFrame operations only.

1. Every row is digested where it is read: (digest, length, stable id, content locator), the locator being the
   file and the row number in it.  A table that does not come from files is written to shared storage first.
2. A stream over the digest table keeps one keyed state per digest, on disk (RocksDB), without watermark and so
   without expiry: number of rows, and stable id and locator of the row that stays.  The state is committed to the
   shared checkpoint folder after each micro-batch of bounded size and read from there as a table.
3. Hits: every row whose digest has another keeper fetches the keeper's bytes by its locator and is compared in
   full.  Rows that only share the digest (none with SHA-256) are grouped by their whole text instead.

Joins that a hot digest can skew have one row per key on the other side, so adaptive skew-join splits them.

Defined results: a null text counts as empty; a null id counts as smaller than any other; of rows that repeat an id
and a text, one stays, chosen by locator; ``keep_id`` is null where the row that stays has a null id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import located, shared_folder, stored

BATCH_BYTES = 128 * 2**20  # of digest rows in one micro-batch
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else 4 MB of disk per partition in advance
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # states of ended streams are unloaded
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def digest_states(digests: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(digest, n_bytes, n, keeper) after streaming all of ``digests`` through keyed state."""
    spark = digests.sparkSession
    source, state = shared_folder(spark, "digests"), shared_folder(spark, "dedup-state")
    digests.write.parquet(source)
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(digests.schema).option("maxBytesPerTrigger", batch_bytes).parquet(source)
        kept = stream.groupBy("digest", "n_bytes").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "loc")).alias("keeper"))
        kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state) \
            .trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.format("statestore").load(state)
    value = [f.name for f in rows.schema["value"].dataType.fields]  # count and max, in the order of agg()
    return rows.select("key.digest", "key.n_bytes", F.col("value")[value[0]].alias("n"),
                       F.col("value")[value[1]].alias("keeper"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                     digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256),
                     batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, digest, loc) per row of ``docs``; the largest id of equal texts stays."""
    content = located(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                                   F.col("__loc").alias("loc"))
    digests = stored(content.select("id", "loc", digest(F.col("text")).alias("digest"),
                                    F.octet_length("text").cast("bigint").alias("n_bytes")), "digested")
    states = stored(digest_states(digests, batch_bytes), "states")
    decided = digests.join(states, ["digest", "n_bytes"])
    hits = decided.filter("loc <> keeper.loc").select("digest", "n_bytes", "loc", F.col("keeper.loc").alias("at"))
    texts = content.select("loc", "text")
    keepers = states.filter("n > 1").select(F.col("keeper.loc").alias("loc")).join(texts, "loc") \
        .select(F.col("loc").alias("at"), F.col("text").alias("other"))
    differ = hits.join(texts, "loc").join(keepers, "at").filter(F.col("text") != F.col("other"))
    mixed = stored(differ.select("digest", "n_bytes").distinct(), "mixed")
    out = decided.select("id", "loc", "digest", F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"),
                         (F.col("loc") == F.col("keeper.loc")).alias("kept"), "n_bytes")
    if not mixed.isEmpty():  # one digest for several texts: those go by their texts
        rows = digests.join(mixed, ["digest", "n_bytes"]).join(texts, "loc")
        own = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"),
                                                 F.max(F.struct("id", "loc")).alias("keeper"))
        exact = rows.join(own, ["digest", "text"]).select(
            "id", "loc", "digest", F.col("keeper.id").alias("keep_id"), "group_size",
            (F.col("loc") == F.col("keeper.loc")).alias("kept"), "n_bytes")
        out = out.join(mixed, ["digest", "n_bytes"], "left_anti").unionByName(exact)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest", "loc")
