"""Job and worker analytics: presence, claims, stalls, limits, merges."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterqa import dims
from rasterqa.functions.numbers import count_where
from rasterqa.operators.ordered import ordered_fold, previous_row, running_sum
from rasterqa.operators.statemaps import accept_within, lockout_outcomes


def latest_by(df: DataFrame, key: str, ts: str, payload: list[str]) -> DataFrame:
    """Newest row per key as one hash aggregate."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*payload), F.struct(ts, *payload)).alias("s"), F.max(ts).alias("last_seen"))
    return best.select(key, "last_seen", *[F.col("s")[c].alias(c) for c in payload])


def with_now(df: DataFrame, clock: DataFrame) -> DataFrame:
    """Attach the reference time, a single row by construction."""
    return df.crossJoin(F.broadcast(clock.select("now").limit(1)))


def running_agents(jobs: DataFrame) -> DataFrame:
    """Workers whose job is running; a paused job proves nothing about its worker."""
    return jobs.filter("status = 'running' and claimed_by is not null").select(
        F.col("claimed_by").alias("agent_id")).distinct()


def busy_agents(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(dims.BUSY_STATUSES) & F.col("claimed_by").isNotNull()).select(
        F.col("claimed_by").alias("agent_id")).distinct()


def online_agents(heartbeats: DataFrame, jobs: DataFrame, clock: DataFrame,
                  window: int = dims.ONLINE_WINDOW_S, grace: int = dims.RUNNING_GRACE_S) -> DataFrame:
    """Workers seen within the window, or within the grace while running a job."""
    seen = with_now(latest_by(heartbeats, "agent_id", "ts", ["username", "logged_in"]), clock)
    runs = running_agents(jobs).withColumn("runs", F.lit(True))
    age = F.col("now") - F.col("last_seen")
    return seen.join(runs, "agent_id", "left").filter(
        (age <= window) | (F.coalesce("runs", F.lit(False)) & (age <= grace))).drop("runs", "now")


def user_status(online: DataFrame, busy: DataFrame) -> DataFrame:
    """Per user: workers online, busy, a free one, and which one to name (signed-in, newest)."""
    flagged = online.join(busy.withColumn("is_busy", F.lit(True)), "agent_id", "left")
    free = F.bool_or(F.col("is_busy").isNull())
    return flagged.groupBy("username").agg(
        F.count("*").alias("agents"), count_where(F.col("is_busy").isNotNull()).alias("busy"), free.alias("has_free"),
        F.bool_or("logged_in").alias("logged_in"),
        F.max_by("agent_id", F.struct("logged_in", "last_seen", "agent_id")).alias("label_agent"))


def user_fleet(users: DataFrame, online: DataFrame) -> DataFrame:
    """Every user with their newest online worker, if any."""
    newest = online.groupBy("username").agg(F.max(F.struct("last_seen", "agent_id")).alias("s"))
    return users.join(newest, "username", "left").select(
        "username", F.col("s").isNotNull().alias("agent_online"), F.col("s.last_seen").alias("agent_last_seen"))


def claimable_jobs(jobs: DataFrame, online: DataFrame, busy: DataFrame) -> DataFrame:
    """Queued jobs whose owner has a free online worker; ownerless jobs suit any free one."""
    free = online.join(busy, "agent_id", "left_anti")
    queued = jobs.filter("status = 'queued'")
    own = queued.filter("created_by <> ''").join(free.select(F.col("username").alias("created_by")), "created_by", "left_semi")
    nobody = queued.filter("coalesce(created_by, '') = ''")
    anyone = nobody.crossJoin(F.broadcast(free.agg((F.count("*") > 0).alias("any")))).filter("any").drop("any")
    return own.unionByName(anyone.select(*own.columns))


def orphaned_jobs(jobs: DataFrame, online: DataFrame) -> DataFrame:
    held = jobs.filter(F.col("status").isin(dims.BUSY_STATUSES) & F.col("claimed_by").isNotNull())
    return held.join(online.select(F.col("agent_id").alias("claimed_by")), "claimed_by", "left_anti")


def requeue(jobs: DataFrame, online: DataFrame, clock: DataFrame, timeout: int = dims.PROGRESS_TIMEOUT_S) -> DataFrame:
    """Held jobs to release: running but silent too long, else owned by an offline worker."""
    held = with_now(jobs.filter(F.col("status").isin(dims.BUSY_STATUSES) & F.col("claimed_by").isNotNull()), clock)
    up = online.select(F.col("agent_id").alias("claimed_by"), F.lit(True).alias("up"))
    silent = (F.col("status") == "running") & (F.col("now") - F.col("last_progress") > timeout) & ~F.col("awaiting_input")
    reason = F.when(silent, f"agent silent > {timeout}s").when(F.col("up").isNull(), "owning agent went offline")
    return held.join(up, "claimed_by", "left").withColumn("reason", reason).filter("reason is not null").drop("up", "now")


def next_jobs(claimable: DataFrame) -> DataFrame:
    """Oldest claimable job per owner, as an aggregate rather than a window."""
    return claimable.groupBy("created_by").agg(F.min(F.struct("created_at", "job_id")).alias("s")).select(
        "created_by", F.col("s.job_id").alias("job_id"), F.col("s.created_at").alias("created_at"))


def step_limit(label: Column) -> Column:
    """Stall limit of a step: the first needle its lower-cased label contains."""
    low = F.lower(F.coalesce(label, F.lit("")))
    out = F.lit(None).cast("int")
    chain = None
    for needle, seconds in dims.STEP_LIMITS:
        hit = F.contains(low, F.lit(needle))
        chain = F.when(hit, seconds) if chain is None else chain.when(hit, seconds)
    return chain.otherwise(dims.DEFAULT_STEP_LIMIT) if chain is not None else out


def stalls(events: DataFrame, end: DataFrame, slot: int = 86400) -> DataFrame:
    """Steps that stayed unchanged for their limit or longer: one alert per stuck step.

    ``events(job_id, event_id, ts, step, status)``. A step starts where the label differs
    from the row before; a pause restarts its clock. ``end(now)`` closes the last step.
    """
    order = ["ts", "event_id"]
    marked = previous_row(events, "job_id", order, ["step", "status"], slot)
    waiting = lambda c: F.coalesce(c.startswith("awaiting_"), F.lit(False))
    fresh = (
        F.col("prev").isNull() | (F.col("prev.step") != F.col("step")) | waiting(F.col("status"))
        | waiting(F.col("prev.status")))
    numbered = running_sum(marked.withColumn("fresh", fresh).drop("prev"), "job_id", order,
                           F.when(F.col("fresh"), 1).otherwise(0), "step_no", slot)
    spans = numbered.groupBy("job_id", "step_no").agg(
        F.min("ts").alias("since"), F.min_by("step", F.struct(*order)).alias("step"),
        F.min_by("status", F.struct(*order)).alias("status"))
    follow = spans.select("job_id", (F.col("step_no") - 1).alias("step_no"), F.col("since").alias("until"))
    closed = with_now(spans.join(follow, ["job_id", "step_no"], "left"), end)
    limit = step_limit(F.col("step"))
    return closed.select(
        "job_id", "step_no", "step", "since", limit.alias("limit_s"),
        (F.coalesce("until", "now") - F.col("since")).alias("stuck_s"), "status",
    ).filter("stuck_s >= limit_s").filter(~waiting(F.col("status"))).drop("status")


def rate_limit(calls: DataFrame, n: int = dims.RATE_LIMIT, window: float = dims.RATE_WINDOW_S,
               slot: int = 86400) -> DataFrame:
    """Accept or reject every call ``(key, call_id, ts)``; rejected calls are not stored.

    A pause longer than the window empties the limiter, so each burst between pauses is
    a unit of its own and a busy key spreads over tasks by burst. A burst is worked out a window's
    length at a time; between them only the last ``n`` accepted times are kept.
    """
    order = ["ts", "call_id"]
    marked = previous_row(calls.select("key", *order), "key", order, ["ts"], slot)
    opens = F.when(F.col("prev").isNull() | (F.col("ts") - F.col("prev.ts") > window), 1).otherwise(0)
    bursts = running_sum(marked.withColumn("opens", opens).drop("prev"), "key", order, F.col("opens"), "burst", slot)

    return ordered_fold(bursts.select("key", "burst", *order), ["key", "burst"], order, accept_within(n, window),
                        "key bigint, call_id bigint, accepted boolean")


def lockouts(attempts: DataFrame, failures: int = dims.LOCKOUT_FAILURES, seconds: float = dims.LOCKOUT_SECONDS,
             slot: int | None = None) -> DataFrame:
    """Outcome of every attempt ``(key, attempt_id, ts, ok)``: refused while locked; the
    fifth failure locks; a success or an expired lock clears the count.

    A key's attempts are cut into slots of ``slot`` seconds (a day, or the length of a lock where that is
    longer) that are worked out side by side, so a busy key spreads over tasks.
    """
    return lockout_outcomes(attempts, failures, seconds, slot or max(86400, math.ceil(seconds)))


def final_status(updates: DataFrame) -> DataFrame:
    """Status per job after a worker's updates ``(job_id, ts, seq, status)``.

    Only terminal values count, the newest wins, and a cancellation absorbs the rest.
    """
    terminal = F.col("status").isin(dims.TERMINAL_STATUSES)
    place = F.struct("ts", "seq")
    agg = updates.groupBy("job_id").agg(
        F.bool_or(F.col("status") == "cancelled").alias("cancelled"),
        F.max_by(F.when(terminal, F.col("status")), F.when(terminal, place)).alias("last"))
    return agg.select("job_id", F.when(F.col("cancelled"), "cancelled").otherwise(F.coalesce("last", F.lit("running"))).alias("status"))


def error_ledger(events: DataFrame) -> DataFrame:
    """Errors and warnings per job; the last error fails the job, a warning does not."""
    err = F.col("is_error")
    agg = events.groupBy("job_id").agg(
        count_where(err).alias("errors"), count_where(~err).alias("warnings"),
        F.max_by(F.when(err, F.col("message")), F.when(err, F.struct("ts", "event_id"))).alias("error"))
    return agg.withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("running"))


def merge_job_fields(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Field-wise merge of two job versions ``(job_id, field, owner, value)``.

    Server-owned fields keep the server's value, worker fields take the worker's, and a
    value only the server computed survives the worker's NULL.
    """
    cur = current.select("job_id", "field", F.col("owner").alias("co"), F.col("value").alias("cv"), F.lit(True).alias("has_c"))
    inc = incoming.select("job_id", "field", F.col("owner").alias("io"), F.col("value").alias("iv"), F.lit(True).alias("has_i"))
    owner = F.coalesce("co", "io")
    value = F.when(owner == "server", F.col("cv")).when(owner == "computed", F.coalesce("iv", "cv")).when(
        F.col("has_i"), F.col("iv")).otherwise(F.col("cv"))
    whole = cur.join(inc, ["job_id", "field"], "full_outer").select("job_id", "field", owner.alias("owner"), value.alias("value"),
                                                                   F.coalesce("has_c", F.lit(False)).alias("known"))
    return whole.filter("known or owner <> 'server'").drop("known")


def validate_requests(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """First unmet rule per request; ``fields`` maps names to text, blank is missing."""
    hit = requests.join(F.broadcast(rules), "workflow").filter(F.coalesce(F.trim(F.col("fields")[F.col("field")]), F.lit("")) == "")
    first = hit.groupBy("request_id").agg(F.min_by("message", "position").alias("message"))
    return requests.select("request_id", "workflow").join(first, "request_id", "left")


def job_heartbeats(jobs: DataFrame, heartbeats: DataFrame, slot: int) -> DataFrame:
    """Heartbeats inside each job's interval ``(job_id, agent_id, start, stop)``: an
    equi-join on worker and time slot, then the exact bounds."""
    span = F.sequence(F.floor(F.col("start") / slot), F.floor(F.col("stop") / slot))
    wide = jobs.select("job_id", "agent_id", "start", "stop", F.explode(span).alias("_slot"))
    beats = heartbeats.select("agent_id", "ts", F.floor(F.col("ts") / slot).alias("_slot"))
    hit = wide.join(beats, ["agent_id", "_slot"]).filter("ts >= start and ts <= stop")
    return hit.select("job_id", "agent_id", "ts")


def pause_transitions(steps: DataFrame) -> DataFrame:
    """Pauses that take effect ``(job_id, seq, stage, kind)``: a stage already answered is ignored."""
    first = steps.filter("kind = 'answer'").groupBy("job_id", "stage").agg(F.min("seq").alias("first_answer"))
    return steps.filter("kind = 'pause'").join(first, ["job_id", "stage"], "left").select(
        "job_id", "seq", "stage", F.coalesce(F.col("first_answer") > F.col("seq"), F.lit(True)).alias("paused"))


def version_at_least(version: Column, minimum: str) -> Column:
    """Dotted version comparison; blank and "unknown" never qualify."""
    parts = lambda v: F.transform(
        F.split(v, r"\."), lambda p: F.coalesce(F.regexp_replace(p, r"\D", "").try_cast("int"), F.lit(0)))
    clean = F.trim(F.coalesce(version, F.lit("")))
    have, need = parts(clean), parts(F.lit(minimum))
    return (clean != "") & (clean != "unknown") & (have >= need)


def job_number(file_name: Column, created: Column, job_id: Column) -> Column:
    """Artwork code from the file name, else a dated number from the job id."""
    code = F.upper(F.regexp_extract(file_name, r"(?i)(AW-[A-Za-z0-9]+-\d{4})", 1))
    dated = F.concat(F.lit("JOB-"), F.date_format(created, "yyyyMMdd"), F.lit("-"), F.upper(F.substring(job_id, 1, 4)))
    return F.when(code != "", code).otherwise(dated)


def safe_client(name: Column) -> Column:
    clean = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"[^A-Za-z0-9 ._-]+", "")
    clean = F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")
    return F.when(clean == "", "Unassigned").otherwise(clean)


def ordered_operations(chosen: DataFrame, order: DataFrame) -> DataFrame:
    """Chosen operations per request in the fixed run order."""
    placed = chosen.join(F.broadcast(order), "operation")
    return placed.groupBy("request_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_set(F.struct("position", "operation"))), lambda s: s["operation"]), ",").alias("operations"))
