"""Size-bounded shards by extendible hashing (operator 5).

Rows are hashed to 64 bits: 32 of the id's MD5, then 32 of the text's MD5.  The directory starts as one bucket; each
round splits only the buckets over the byte limit, on the next bit, so the depth differs between shards and grows
with the logarithm of the input.  Rounds up to ``FINE_BITS`` run on a table of that many cells, later ones (for
buckets that are still too large) on the rows' own hashes.  A bucket left over the limit after all bits holds rows
with one hash, that is copies: it is cut into overflow pages of as many rows as fit.  A single row over the limit is a
shard of its own.

Defined results: a null id or text is hashed as empty text; rows that repeat are placed one by one; an empty table has
no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import numbered, stored

BITS = 64
FINE_BITS = 20


def _bits(text: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 8), 16, 2), 32, "0")


def hash_bits(id_col: str, text_col: str) -> Column:
    return F.concat(_bits(F.col(id_col).cast("string")), _bits(F.col(text_col)))


def _split(cells: DataFrame, first: int, last: int, limit: int) -> tuple[DataFrame | None, DataFrame]:
    """Directory entries (shard, shard_bytes, shard_rows) found at depths first..last, and what is still too large."""
    leaves, live = None, cells
    for depth in range(first, last + 1):
        sums = live.groupBy(F.substring("bits", 1, depth).alias("shard")) \
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        sums = stored(sums.withColumn("over", (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)), "buckets")
        done = sums.filter("not over").drop("over")
        leaves = done if leaves is None else leaves.unionByName(done)
        over = sums.filter("over").select("shard")
        live = live.join(over, F.substring("bits", 1, depth) == F.col("shard"), "left_semi")
        if over.isEmpty():
            break
        if depth % 8 == 7:
            live = stored(live, "cells")
    return leaves, live


def place_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int) -> DataFrame:
    """(id, n_bytes, shard, shard_bytes, shard_rows) per row; ``shard`` is the hash prefix, with ``+page`` on overflow."""
    rows = stored(docs.select(F.col(id_col).alias("id"), hash_bits(id_col, text_col).alias("bits"),
                              F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes")), "hashed")
    fine = stored(rows.groupBy(F.substring("bits", 1, FINE_BITS).alias("bits")).agg(
        F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "cells")
    leaves, live = _split(fine, 0, FINE_BITS, limit)
    if not live.isEmpty():
        dense = rows.join(live.select(F.col("bits").alias("cell")), F.substring("bits", 1, FINE_BITS) == F.col("cell"),
                          "left_semi").groupBy("bits").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        more, live = _split(stored(dense, "cells"), FINE_BITS + 1, BITS, limit)
        leaves = leaves.unionByName(more)
    directory = stored(leaves, "directory")
    # every depth that occurs is one equality join; a row finds exactly one entry
    depths = [r.d for r in directory.select(F.length("shard").alias("d")).distinct().collect()]
    keys = F.array(*[F.substring("bits", 1, d) for d in sorted(depths)])
    placed = rows.withColumn("shard", F.explode(keys)).join(directory, "shard") if depths else \
        rows.withColumn("shard", F.lit("")).join(directory, "shard")
    placed = placed.select("id", "n_bytes", "shard", "shard_bytes", "shard_rows")
    if not live.isEmpty():
        copies = rows.join(live.select("bits").distinct(), "bits", "left_semi")
        placed = placed.unionByName(_overflow(stored(copies, "copies"), limit))
    return placed.withColumnRenamed("id", id_col)


def _overflow(copies: DataFrame, limit: int) -> DataFrame:
    """Pages of rows with one hash; they are copies, so all have the size of the largest."""
    sizes = stored(copies.groupBy("bits").agg(F.count(F.lit(1)).alias("c"), F.max("n_bytes").alias("most")), "sizes")
    largest = sizes.agg(F.max("c")).first()[0] or 0
    fits = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("most", F.lit(1))))
    paged = numbered(copies, ["bits"], largest).join(sizes, "bits") \
        .withColumn("shard", F.concat("bits", F.lit("+"), F.floor(F.col("rank") / fits).cast("string")))
    sums = paged.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return paged.join(sums, "shard").select("id", "n_bytes", "shard", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` with one folder per shard; ids must be unique here."""
    tagged = docs.join(placed.select(id_col, "shard"), id_col)
    tagged.repartition("shard").write.partitionBy("shard").parquet(path)
