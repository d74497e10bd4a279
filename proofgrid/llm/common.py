"""Shared pieces of the training-data operators: tables written to shared storage, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage once and read it from there: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(df: DataFrame) -> DataFrame:
    """``df`` with ``__loc``, the file and row number of each row; what is no scan of files is stored first."""
    try:
        meta = df.metadataColumn("_metadata")
    except AnalysisException:
        df = stored(df, "content")
        meta = df.metadataColumn("_metadata")
    return df.withColumn("__loc", F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
             schema: str) -> DataFrame:
    """``mapInArrow`` with batches of about ``SLICE_BYTES``, unless the session names another size.

    A batch is held by the executor and by its Python worker, so its size bounds the memory of both.  Workers are used
    again by later stages: what earlier tasks freed goes back to the machine before a task begins.
    """
    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        yield from run(batches)

    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(SLICE_BYTES))
    return df.mapInArrow(begin, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to slices of Arrow batches; a slice holds a bounded number of rows and about ``SLICE_BYTES``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield fn(part)

    return in_arrow(df, run, schema)


SLICE_BYTES = 4_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``SLICE_BYTES`` (one row at least)."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def small_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A table of driver-side values of bounded size, sent as Arrow: no Python worker unpickles its rows."""
    return spark.createDataFrame(pa.table(columns))


def long_lists(parts: list[np.ndarray]) -> pa.ListArray:
    """A list<int64> column from one int64 array per row."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64, copy=False)))


def numbered(df: DataFrame, keys: list[str], largest: int, slice_rows: int = 20_000) -> DataFrame:
    """Add ``rank``, 0-based within ``keys``; ``largest`` is the row count of the largest key.

    ``df`` must be a scan of stored files.  Rows are dealt to slices of each key by their place in the files, numbered
    there, and shifted by the counts of the earlier slices: no window sees more than a slice of a hot key.
    """
    parts = max(16, 2 * largest // slice_rows)
    sliced = located(df).withColumn("__slice", F.pmod(F.xxhash64("__loc"), F.lit(parts)))
    counts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*keys, "__slice", (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slice"))
                                              - F.col("__n")).alias("__before"))
    within = Window.partitionBy(*keys, "__slice").orderBy("__loc")
    return sliced.withColumn("__r", F.row_number().over(within)).join(before, [*keys, "__slice"]) \
        .withColumn("rank", F.col("__r") - 1 + F.col("__before")).drop("__slice", "__loc", "__r", "__before")
