"""Vault change feed: ticks, revisions, changed folders, recent items.

As a stream: ``poll_ticks`` numbers the entries, ``machines.change_stream`` finds what changed,
``publish`` appends it to a versioned table, and ``folder_revisions``, ``changed_since`` and
``recent_feed`` read that table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterqa.functions.text import customer_folder, display_name, is_sent_file

RECENT_MAX = 250
FOLDER_MAX = 800
#: Ticks ranked by one task; half a week of them, one every four seconds.
TICK_SLOT = 1 << 16
#: How far a poll reads behind its cursor, and the first poll behind its start.
OVERLAP_MS = 120_000
LOOKBACK_MS = 24 * 3600 * 1000


def poll_ticks(entries: DataFrame, start_ms: int, every_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """Number the polls at ``start_ms + tick * every_ms`` and give each entry the first that reads it.

    ``entries(path, etag, modified_ms)``. Tick 0 is a cold start and looks back ``lookback_ms``; older
    entries are left out. A poll also reads what is ``OVERLAP_MS`` older than its cursor, so entries that
    show up late are met as long as they are no later than that: ``event_time`` carries a watermark of this length
    on a stream. Entries read again have the etag they had, and change nothing.
    """
    tick = F.greatest(F.lit(0), F.ceil((F.col("modified_ms") - start_ms) / every_ms)).cast("bigint")
    read = entries.filter(F.col("modified_ms") > start_ms - lookback_ms - OVERLAP_MS).withColumns(
        {"tick": tick, "event_time": F.timestamp_millis(F.greatest("modified_ms", F.lit(start_ms)))})
    return read.withWatermark("event_time", f"{OVERLAP_MS} milliseconds") if entries.isStreaming else read


def changed_entries(ticks: DataFrame) -> DataFrame:
    """Entries whose etag differs from the same path's last one, over numbered ticks.

    ``ticks(tick, path, etag, modified_ms)``. One row per path and tick; the comparison
    runs along a path's own ticks.
    """
    from rasterqa.operators.ordered import previous_row

    marked = previous_row(ticks, "path", ["tick"], ["etag"], 1 << 16)
    return marked.filter(F.col("prev").isNull() | (F.col("prev.etag") != F.col("etag"))).drop("prev")


def change_items(changed: DataFrame, root: str, after: int = 0, first_tick: int = 0) -> DataFrame:
    """Published items: customer, folder, revision; the first tick is history, not new.

    Revisions count ticks that published anything, on from ``after``. They are ranked inside slots of ticks, on top
    of what the earlier slots hold, so only one row per slot passes through one task.
    """
    ticks = changed.select("tick").distinct().withColumn("slot", F.floor(F.col("tick") / TICK_SLOT))
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = ticks.groupBy("slot").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranked = ticks.withColumn("at", F.row_number().over(Window.partitionBy("slot").orderBy("tick"))).join(slots, "slot").select(
        "tick", (F.col("before") + F.col("at") + after).cast("int").alias("revision"))
    customer = customer_folder(F.col("path"), root)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(root)
    return changed.join(ranked, "tick").select(
        "*", customer.alias("customer"), display_name(customer).alias("customer_label"), folder.alias("folder"),
        (F.col("tick") > first_tick).alias("is_new"), is_sent_file(F.col("path")).alias("sent"))


def publish(changed: DataFrame, root: str, folder: str, first_tick: int = 0) -> DataFrame:
    """Append what a change stream finds to the versioned table ``folder/changes`` and read it back.

    Each micro-batch writes its own ``batch`` with the revisions after those of the batches before
    it; revisions are partitions, so looking up the last one reads no rows. A batch that runs again
    finds the same start and replaces its own rows: a restart neither skips nor repeats a revision. Batches come in
    tick order; a tick that is spread over two batches gets a revision in each.
    """
    spark = changed.sparkSession
    base = folder.rstrip("/")
    table = f"{base}/changes"

    def store(batch: DataFrame, batch_id: int) -> None:
        last = 0
        if has_rows(batch.sparkSession, table):
            before = batch.sparkSession.read.parquet(table).filter(F.col("batch") < batch_id)
            last = before.agg(F.max("revision").alias("last")).first().last or 0
        items = change_items(batch.drop("is_new"), root, last, first_tick)
        items.write.mode("overwrite").partitionBy("revision").parquet(f"{table}/batch={batch_id}")

    query = (
        changed.writeStream.foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if has_rows(spark, table):
        return spark.read.parquet(table)
    nothing = spark.createDataFrame([], changed.drop("is_new").schema)
    return change_items(nothing, root).withColumn("batch", F.lit(0))


def has_rows(spark, table: str) -> bool:
    """Whether a folder holds any Parquet file yet."""
    try:
        spark.read.parquet(table)
    except AnalysisException:
        return False
    return True


def changed_since(items: DataFrame, revision: int) -> DataFrame:
    """Folders that changed after a revision, with the arrivals among them that are new."""
    after = items.filter(F.col("revision") > revision)
    return after.groupBy("folder").agg(F.max("revision").alias("revision"),
                                       F.count_if(F.col("is_new") & ~F.col("sent")).alias("n_new"))


def folder_revisions(items: DataFrame) -> DataFrame:
    return items.groupBy("folder").agg(F.max("revision").alias("revision"))


def prune_folders(folders: DataFrame, cap: int = FOLDER_MAX) -> DataFrame:
    """All folders, or the newest half of the cap once there are more than the cap."""
    total = F.broadcast(folders.agg(F.count("*").alias("n")))
    newest = folders.orderBy(F.desc("revision"), "folder").limit(cap // 2)
    few = folders.crossJoin(total).filter(F.col("n") <= cap).drop("n")
    many = newest.crossJoin(total).filter(F.col("n") > cap).drop("n")
    return few.unionByName(many)


def recent_feed(items: DataFrame, limit: int = RECENT_MAX) -> DataFrame:
    """Newest arrivals first, sent files left out."""
    return items.filter(~F.col("sent")).orderBy(F.desc("revision"), F.desc("modified_ms"), "path").limit(limit)
