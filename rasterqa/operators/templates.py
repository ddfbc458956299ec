"""Template library: placeholders, versions, use per job, and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterqa import dims

MANAGED_VAR = r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}"


def managed_fields(text: Column) -> Column:
    """Sorted distinct ``{{name}}`` placeholders."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(MANAGED_VAR), F.lit(1))))


def builtin_fields(text: Column) -> Column:
    """Sorted distinct ``{name}`` placeholders; doubled braces are literal."""
    bare = F.regexp_replace(text, r"\{\{|\}\}", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\{([A-Za-z0-9_]+)\}"), F.lit(1))))


def to_builtin(text: Column) -> Column:
    """``{{name}}`` text to ``{name}`` text, literal braces doubled."""
    marked = F.regexp_replace(text, MANAGED_VAR, "\u0001$1\u0002")
    doubled = F.replace(F.replace(marked, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    return F.replace(F.replace(doubled, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))


def to_managed(text: Column) -> Column:
    """The inverse of ``to_builtin``."""
    parked = F.replace(F.replace(text, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    named = F.regexp_replace(parked, r"\{([A-Za-z0-9_]+)\}", "{{$1}}")
    return F.replace(F.replace(named, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))


def resolve(templates: DataFrame, managed: DataFrame) -> DataFrame:
    """Text to run per template: the managed version if its placeholders match the
    built-in ones exactly, else the built-in, with what was unknown or missing.

    ``templates(name, key, builtin)``, ``managed(key, version_id, number, text)``.
    """
    joined = templates.join(managed, "key", "left")
    live = F.trim(F.coalesce("text", F.lit(""))) != ""
    have, need = managed_fields(F.col("text")), builtin_fields(F.col("builtin"))
    unknown, missing = F.array_except(have, need), F.array_except(need, have)
    use = live & (F.size(unknown) == 0) & (F.size(missing) == 0)
    return joined.select(
        "name", "key", F.when(use, to_builtin(F.col("text"))).otherwise(F.col("builtin")).alias("run_text"),
        F.when(use, "managed").otherwise("built_in").alias("source"), F.when(use, F.col("number")).alias("version"),
        F.when(live, F.array_join(unknown, ",")).alias("unknown"), F.when(live, F.array_join(missing, ",")).alias("missing"))


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")


def edited(submitted: DataFrame, served: DataFrame) -> DataFrame:
    """Submitted texts ``(id, name, text)`` that match no served text of their template.

    Texts meet as hashes of their normal form, so long texts are not shuffled twice.
    """
    mark = lambda df: df.withColumn("text_hash", F.sha2(normal_text(F.col("text")), 256))
    real = submitted.filter(normal_text(F.col("text")) != "")
    return mark(real).join(mark(served).select("name", "text_hash"), ["name", "text_hash"], "left_anti").drop("text_hash")


def dynamic_ops(managed: DataFrame) -> DataFrame:
    """Published one-step operations: a safe key under the prefix, no placeholder in it."""
    suffix = F.substr("key", F.lit(len(dims.DYNAMIC_PREFIX) + 1))
    ok = F.col("key").startswith(dims.DYNAMIC_PREFIX) & suffix.rlike("^[A-Z0-9_]{1,80}$") & (
        F.trim("text") != "") & ~F.col("text").rlike(MANAGED_VAR)
    return managed.filter(ok).select(F.concat(F.lit(dims.DYNAMIC_OP_PREFIX), F.lower(suffix)).alias("op_key"), "key", "text")


def usage_rows() -> list[tuple[str, str, str, int, str]]:
    """(kind, workflow, choice, position, template) of every fixed use."""
    rows = []
    for flow, names in dims.WORKFLOW_TEMPLATES.items():
        rows += [("workflow", flow, "", i, n) for i, n in enumerate(names)]
    for mode, names in dims.TEXT_MODE_TEMPLATES.items():
        rows += [("mode", "text", mode, i, n) for i, n in enumerate(names)]
    for op, names in dims.OPERATION_TEMPLATES.items():
        rows += [("operation", "custom", op, i, n) for i, n in enumerate(names)]
    for flow in dims.SHARED_TAIL_WORKFLOWS:
        rows += [("tail", flow, "", 100 + i, n) for i, n in enumerate(dims.SHARED_TAIL)]
    return rows


def templates_for_job(jobs: DataFrame, usage: DataFrame) -> DataFrame:
    """Templates each job ``(job_id, workflow, choice)`` can use, in order.

    ``choice`` is the text mode or the operation; an unknown mode gets the full set.
    """
    uses = F.broadcast(usage)
    modes = F.broadcast(usage.filter("kind = 'mode'").select(F.col("choice").alias("m")).distinct())
    typed = jobs.join(modes, F.col("choice") == F.col("m"), "left").withColumn(
        "kind", F.when(F.col("workflow") == "custom", "operation")
        .when((F.col("workflow") == "text") & F.col("m").isNotNull(), "mode").otherwise("workflow")).drop("m")
    wanted = typed.withColumn("pick", F.when(F.col("kind") == "workflow", "").otherwise(F.col("choice")))
    uses_main = uses.select("kind", "workflow", F.col("choice").alias("pick"), "position", "template")
    main = wanted.join(uses_main, ["kind", "workflow", "pick"]).select("job_id", "position", "template")
    tail = jobs.join(F.broadcast(usage.filter("kind = 'tail'").select("workflow", "position", "template")), "workflow").select(
        "job_id", "position", "template")
    return main.unionByName(tail)


def template_regex(text: Column, is_block: Column | None = None) -> Column:
    """Pattern matching any text the template can produce: literals quoted, fields free.
    Blocks may stand inside a text, others make up the whole of it."""
    parked = F.replace(F.replace(text, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    quoted = F.concat(F.lit("\\Q"), F.regexp_replace(parked, r"\{[A-Za-z0-9_]+\}", r"\\E.*?\\Q"), F.lit("\\E"))
    inner = F.replace(F.replace(quoted, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))
    whole = F.concat(F.lit("(?s)^"), inner, F.lit("$"))
    return whole if is_block is None else F.when(is_block, F.concat(F.lit("(?s)"), inner)).otherwise(whole)


def attribute_runs(sent: DataFrame, patterns: DataFrame) -> DataFrame:
    """Which template produced each sent text ``(job_id, seq, text)``.

    ``patterns(name, position, pattern, is_block)``: a few dozen rows, broadcast. Blocks
    may match inside a text, others must match it whole. First candidate wins.
    """
    joined = sent.join(F.broadcast(patterns), F.expr("text rlike pattern"))
    best = joined.groupBy("job_id", "seq").agg(F.min(F.struct("position", "name")).alias("s"))
    return best.select("job_id", "seq", F.col("s.name").alias("name"))


#: Between the sent texts of a run, and the length at which its log is cut.
RUN_GAP = "\n\n----- next send -----\n\n"
RUN_LENGTH = 200_000


def prompt_runs(attributed: DataFrame, sent: DataFrame, jobs: DataFrame) -> DataFrame:
    """Run log: one row per job and template with the exact texts sent, joined in order."""
    status = F.create_map(*[F.lit(v) for kv in dims.RUN_STATUS.items() for v in kv])
    # what lies beyond the log's length is never gathered
    line = Window.partitionBy("job_id", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    runs = attributed.join(sent, ["job_id", "seq"])
    placed = runs.withColumn("at", F.coalesce(F.sum(F.length("text") + len(RUN_GAP)).over(line), F.lit(0)))
    placed = placed.withColumn("text", F.when(F.col("at") < RUN_LENGTH, F.col("text")))
    texts = placed.groupBy("job_id", "name").agg(
        F.count("*").alias("times_sent"),
        F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "text")))), lambda s: s["text"]),
                                 RUN_GAP), 1, RUN_LENGTH).alias("resolved"))
    return texts.join(jobs, "job_id").filter(F.col("status").isin(dims.TERMINAL_STATUSES)).select(
        "job_id", "name", "times_sent", "resolved", status[F.col("status")].alias("run_status"), "latency_ms",
        F.substring("error", 1, 5000).alias("error"))


def version_diff(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows added or changed since the last snapshot, compared by row hash."""
    digest = lambda df: df.withColumn("_h", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))
    old = digest(before).select(key, "_h")
    return digest(now).join(old, [key, "_h"], "left_anti").drop("_h")
