"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterqa.session import shared_folder

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again.

    Cuts lineage and columns stay prunable; a lost executor rereads files. What was shuffled for
    it isn't needed any more then, so Spark removes those files as soon as the write ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Python tasks of this session get Arrow batches of at most ``size``, unless the session names a size itself.

    Spark's default counts rows (10,000) up to 64 MB; each running task holds a batch twice in the JVM's
    native memory and again in its Python worker. No operator's result depends on where batches are cut.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_fold(folds: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
