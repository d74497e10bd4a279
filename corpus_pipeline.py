"""From raw documents to packed training sequences: five stages, each over all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.  Rows are matched by
their place in the files, never by position in a result or by ``doc_id``, which may repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm import decontaminate, exact_dedup, language, near_dup, packing
from proofgrid.llm.common import located, stored

LEAST_LANGUAGE_SHARE = 0.4  # of a text's letters; below it no language holds the text


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language has its share, go."""
    found = language.identify(docs, train=F.lit(True), columns=docs.columns, with_spans=False)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)) \
        .select(docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays."""
    placed = located(docs)
    gone = stored(exact_dedup.exact_duplicates(docs).filter("not kept").select("loc"), "duplicates")
    return placed.join(gone, F.col("__loc") == F.col("loc"), "left_anti").select(docs.columns)


def _without(placed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose place is not among ``gone``: an id may name several documents."""
    return placed.join(stored(gone, "dropped"), F.col("__loc") == F.col("loc"), "left_anti").drop("__loc")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: the least id, then the first place."""
    placed = located(docs)
    named = placed.select(F.struct("doc_id", "__loc").alias("row"), "text")
    found = near_dup.near_duplicates(named, "row")
    return _without(placed, found.filter("not kept").select(F.col("row.__loc").alias("loc")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    placed = located(docs)
    found = decontaminate.find_matches(placed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__loc")
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, r: n + r["past"] - r["first"])
    return _without(placed, found.filter((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).select(F.col("__loc").alias("loc")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None  # models, tokenizers and components have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to shared storage and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
