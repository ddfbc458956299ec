"""Run a stream over the data at hand and hand its output back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rasterqa.session import shared_folder


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for one run's outputs and checkpoint, in the cluster's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process everything available once, exactly-once into parquet, and read it back.

    A run with the same ``folder`` resumes: its checkpoint knows what was read and what state was kept.
    """
    spark = stream.sparkSession
    base = (folder or new_folder(spark)).rstrip("/")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start(f"{base}/out")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def read_stream(spark: SparkSession, folder: str, glob: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """Stream over the parquet files of a folder with the schema they already have, at most
    ``max_files`` in a micro-batch."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(folder)


def read_table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream over the table ``folder/name.parquet``, one Parquet file or a folder of them."""
    # a pattern of one path: without it a file would be taken for the folder that partitions lie in
    path = f"{folder.rstrip('/')}/{name}[.]parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)
