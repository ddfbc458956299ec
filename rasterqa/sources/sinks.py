"""Sinks: user logs, versioned output layout, free names, catalogue export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterqa.functions.text import safe_file_name
from rasterqa.operators.ordered import running_sum

SLOT = 1 << 20  # positions per slot: a name shared by many files is numbered slot by slot


def user_log_lines(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One text line per diagnostics entry with the file-safe user it belongs to, and the columns to ``keep``."""
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(F.col(c))
    tail = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), F.col(c))).otherwise("")
    line = F.concat(
        F.col("time"), F.lit(" ["), F.col("kind"), F.lit("] job="), dash("job_id"), F.lit(" wf="), dash("workflow"),
        F.lit(" step="), dash("step"), tail(" exc=", "exc_type"), tail(" :: ", "message"), tail(" | ", "detail"))
    return entries.select(safe_file_name(F.col("username")).alias("user_key"), line.alias("value"), *keep)


def write_user_logs(entries: DataFrame, path: str) -> None:
    user_log_lines(entries).write.mode("append").partitionBy("user_key").text(path)


def vault_layout(outputs: DataFrame, existing: DataFrame) -> DataFrame:
    """Versioned path per output: run = runs on disk + 1, version = order within the task.

    ``outputs(client, task, position, ...)``, ``existing(client, task, run)``.
    """
    runs = existing.groupBy("client", "task").agg(F.count_distinct("run").alias("runs"))
    placed = running_sum(outputs, ["client", "task"], ["position"], F.lit(1), "version", SLOT)
    numbered = placed.join(runs, ["client", "task"], "left").withColumn("run", F.coalesce("runs", F.lit(0)) + 1)
    name = F.format_string("%s_R%d_V%d.png", "task", "run", "version")
    return numbered.drop("runs").withColumn("path", F.concat_ws("/", "client", "task", F.concat(F.lit("run_"), "run"), name))


def dedupe_names(files: DataFrame, taken: DataFrame, style: str = "_", tries: int | None = None) -> DataFrame:
    """Free name per file ``(folder, name, position)``: ``x_2.png`` or ``x_v2.png`` style.

    ``taken(folder, stem, suffix, n)`` says how many forms of a name exist already. Past
    ``tries`` the name is NULL (refused).
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    split = files.withColumn("stem", stem).withColumn("suffix", suffix)
    ranked = running_sum(split, ["folder", "stem", "suffix"], ["position"], F.lit(1), "k", SLOT)
    numbered = ranked.join(taken, ["folder", "stem", "suffix"], "left").withColumn(
        "k", F.col("k") + F.coalesce("n", F.lit(0)))
    free = F.when(F.col("k") == 1, F.concat("stem", "suffix")).otherwise(
        F.concat(F.col("stem"), F.lit(style), F.col("k"), F.col("suffix")))
    named = free if tries is None else F.when(F.col("k") <= tries, free)
    return numbered.withColumn("free_name", named).drop("stem", "suffix", "n", "k")


def export_templates(templates: DataFrame) -> DataFrame:
    """Catalogue rows in export order, with the placeholders each text uses."""
    fields = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{([A-Za-z0-9_]+)\}"), F.lit(1))))
    return templates.select("workflow", "step", "key", F.array_join(fields, ",").alias("placeholders"), "active").orderBy("workflow", "step", "key")
