"""Diagnostics delivery: redact, then append each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterqa import schemas
from rasterqa.functions.text import drop_secret_keys, redact
from rasterqa.streaming.runner import new_folder


def clean_entries(entries: DataFrame) -> DataFrame:
    """Free-text fields redacted, secret keys of maps dropped; the stored copy never holds the raw text."""
    kinds = dict(entries.dtypes)
    fields = [c for c in ("message", "traceback", "step", "detail") if kinds.get(c) == "string"]
    maps = [c for c, kind in kinds.items() if kind.startswith("map<string,")]
    return entries.withColumns({**{c: redact(F.col(c)) for c in fields}, **{c: drop_secret_keys(F.col(c)) for c in maps}})


def read_queue(spark: SparkSession, folder: str, glob: str = "*.json*", max_files: int | None = None) -> DataFrame:
    """Stream of diagnostics entries from the JSON-lines files of a folder, oldest file first.

    Blank lines are skipped. A line that is no entry comes with ``unreadable`` set to its text and all
    else null; ``deliver`` puts those aside, ``readable`` leaves them out.
    """
    reader = spark.readStream.option("pathGlobFilter", glob).option("latestFirst", "false")
    lines = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).text(folder)
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", schemas.DIAG_ENTRY + ", unreadable string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"}).alias("e"))
    return parsed.select("e.*")


def readable(entries: DataFrame) -> DataFrame:
    return entries.filter("unreadable is null").drop("unreadable")


def deliver(entries: DataFrame, folder: str | None = None) -> DataFrame:
    """At-least-once source, idempotent sink: a repeated batch overwrites its own folder.

    Batches go out in order and a failing one ends the run; the next run with the same ``folder``
    starts there. Lines that ``read_queue`` could not read go to ``folder/unreadable``, redacted too: they
    neither block the queue nor get lost.
    """
    spark = entries.sparkSession
    base = (folder or new_folder(spark)).rstrip("/")

    def store(batch: DataFrame, batch_id: int) -> None:
        if "unreadable" in batch.columns:
            aside = batch.filter("unreadable is not null").select(redact(F.col("unreadable")).alias("line"))
            aside.write.mode("overwrite").parquet(f"{base}/unreadable/batch={batch_id}")
            batch = readable(batch)
        clean_entries(batch).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (
        entries.writeStream.foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
