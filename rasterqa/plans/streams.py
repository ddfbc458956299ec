"""Streaming queries: each runs over the given tables until nothing is left to read."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterqa.plans.events import _STEPS, CLOCK, DAY, EVS, SECONDS
from rasterqa.plans.registry import ORACLES, query
from rasterqa.plans.text import T0, VAULT, _redact_sql, vault
from rasterqa.streaming import changes, machines
from rasterqa.streaming.delivery import deliver, read_queue
from rasterqa.streaming.queries import loop_summary
from rasterqa.streaming.runner import new_folder, read_table_stream, run_available


def stream_of(t, name):
    return read_table_stream(t.spark, t.sf_dir, name)


def events_stream(t):
    """Event stream with second stamps and the time column the watermark reads."""
    return stream_of(t, "events").withColumn("event_time", F.col("ts").cast("timestamp")).withColumn("ts", SECONDS("ts"))


def replay(pages):
    """Ticks of the change feed: every entry comes in its own tick and again in the next
    (overlap); every third page has changed by then."""
    own = (F.col("page_id") % 4).cast("bigint")
    again = F.when(F.col("page_id") % 3 == 0, F.concat("etag", F.lit("2"))).otherwise(F.col("etag"))
    path = F.concat("path", F.lit("/"), "page_id")
    seen = F.explode(F.array(F.struct(own.alias("tick"), F.col("etag").alias("etag")), F.struct((own + 1).alias("tick"), again.alias("etag"))))
    return pages.select(path.alias("path"), "modified_ms", seen.alias("s")).select("path", "s.tick", "s.etag", "modified_ms")


_REPLAY = ("rp AS MATERIALIZED (SELECT path || '/' || page_id AS path, modified_ms, CAST(page_id % 4 AS BIGINT) AS tick, etag FROM vt UNION ALL "
           "SELECT path || '/' || page_id, modified_ms, CAST(page_id % 4 + 1 AS BIGINT), CASE WHEN page_id % 3 = 0 THEN etag || '2' ELSE etag END FROM vt), "
           "ch AS MATERIALIZED (SELECT path, tick, etag, modified_ms FROM (SELECT *, lag(etag) OVER (PARTITION BY path ORDER BY tick) AS p FROM rp) WHERE p IS NULL OR p <> etag)")
ST1 = f"WITH {VAULT}, {_REPLAY} SELECT * FROM ch"


@query("st1_change_feed", ST1)
def st1_change_feed(t):
    pages = vault(lambda name: stream_of(t, name))
    return run_available(machines.change_stream(replay(pages), memory=1)).drop("is_new")


@query("st1_change_feed_batch", ST1)
def st1_change_feed_batch(t):
    return changes.changed_entries(replay(vault(t))).select("path", "tick", "etag", "modified_ms")


def items(t):
    return changes.change_items(changes.changed_entries(replay(vault(t))), "root")


_ITEMS = f"{VAULT}, {_REPLAY}, it AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY tick) AS revision, regexp_replace(path, '/[^/]*$', '') AS folder FROM ch)"


def published(t):
    """The same items from the stream: change machine, then one versioned batch after the other."""
    changed = machines.change_stream(replay(vault(lambda name: stream_of(t, name))), memory=1)
    return changes.publish(changed, "root", new_folder(t.spark))


ST2 = f"WITH {_ITEMS} SELECT folder, CAST(max(revision) AS INT) AS revision FROM it GROUP BY folder"


@query("st2_revisions_stream", ST2)
def st2_revisions_stream(t):
    return changes.folder_revisions(published(t))


@query("st2_changed_since", f"WITH {_ITEMS} SELECT folder, CAST(max(revision) AS INT) AS revision, count(*) FILTER (tick > 0 AND len(list_filter(string_split(path, '/')[1:-2], lambda p: lower(p) IN ('sent', 'outgoing'))) = 0) AS n_new FROM it WHERE revision > 2 GROUP BY folder")
def st2_changed_since(t):
    return changes.changed_since(items(t), 2)


@query("st2_folder_revisions", ST2)
def st2_folder_revisions(t):
    return changes.folder_revisions(items(t))


@query("st3_recent_feed", f"WITH {_ITEMS} SELECT path, CAST(revision AS INT) AS revision, tick > 0 AS is_new FROM it ORDER BY revision DESC, modified_ms DESC, path LIMIT 250")
def st3_recent_feed(t):
    return changes.recent_feed(items(t)).select("path", "revision", "is_new")


@query("st4_presence", f"""WITH {EVS}, {CLOCK}, wm AS (SELECT max(epoch_ms(ts)) - 600000 AS wm FROM events), pv AS (SELECT user_id AS agent_id, ts, lag(ts) OVER w AS p, lead(ts) OVER w AS n FROM evs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT agent_id, ts, 'online' AS state FROM pv WHERE p IS NULL OR ts - p > 21600 UNION ALL SELECT agent_id, ts + 21600, 'offline' FROM pv, wm WHERE (n IS NOT NULL AND n - ts > 21600) OR (n IS NULL AND (ts + 21600) * 1000 < wm)""")
def st4_presence(t):
    # Six hours of silence instead of 90 seconds, to fit the table's gaps.
    beats = events_stream(t).select(F.col("user_id").alias("agent_id"), "ts", "event_time").withWatermark("event_time", "10 minutes")
    return run_available(machines.presence_stream(beats, 21600))


@query("st5_stalls")
def st5_stalls(t):
    step = F.when(F.col("event_type") == "click", "upload file").when(F.col("event_type") == "view", "detect objects").otherwise(F.col("event_type"))
    rows = events_stream(t).select(
        F.col("user_id").alias("job_id"), "event_id", "ts", step.alias("step"),
        F.when(F.col("event_type") == "signup", "awaiting_selection").otherwise("running").alias("status"), "event_time")
    return run_available(machines.stall_stream(rows.withWatermark("event_time", "10 minutes")))


@query("st6_rate_limit", None)
def st6_rate_limit(t):
    calls = events_stream(t).select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), "ts", "event_time").withWatermark("event_time", "10 minutes")
    return run_available(machines.limit_stream(calls, n=2, window=DAY))


@query("st6_lockouts", None)
def st6_lockouts(t):
    tries = events_stream(t).select(F.col("user_id").alias("key"), F.col("event_id").alias("attempt_id"), "ts",
                                    F.col("event_type").isin("purchase", "signup").alias("ok"), "event_time").withWatermark("event_time", "10 minutes")
    return run_available(machines.lockout_stream(tries, seconds=DAY))


_E6 = ORACLES["e6_stalls"]
_LIMIT = _E6[_E6.index("CAST(CASE WHEN contains"):_E6.index(" AS limit_s")]
ORACLES["st5_stalls"] = _E6.replace(
    "ORDER BY step_no), now)", f"ORDER BY step_no), CASE WHEN (since + {_LIMIT}) * 1000 < (SELECT max(epoch_ms(ts)) - 600000 FROM events) THEN since + 100000 ELSE since END)"
).replace("SELECT job_id, step_no, step, since, limit_s, stuck_s FROM", "SELECT job_id, step, since, limit_s FROM")
ORACLES["st6_rate_limit"] = ORACLES["e7_rate_limit"]
ORACLES["st6_lockouts"] = ORACLES["e8_lockouts"]


@query("st7_loop_summary", f"""WITH {EVS}, wm AS (SELECT (max(epoch_ms(ts)) - 600000) AS wm FROM events) SELECT ts // 300 * 300 AS slot, count(*) AS polls, count(*) FILTER (event_type = 'view') AS idle,
 count(*) FILTER (event_type = 'purchase') AS jobs, count(*) FILTER (event_type = 'error') AS errors FROM evs GROUP BY 1 HAVING (ts // 300 * 300 + 300) * 1000 <= (SELECT wm FROM wm)""")
def st7_loop_summary(t):
    stream = stream_of(t, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    return run_available(loop_summary(stream))


@query("st8_diag_delivery", f"SELECT doc_id, md5({_redact_sql('text')}) AS message FROM documents")
def st8_diag_delivery(t):
    entries = stream_of(t, "documents").select("doc_id", F.col("text").alias("message"))
    return deliver(entries).select("doc_id", F.md5("message").alias("message"))


@query("st9_pause_machine", f"WITH {_STEPS} SELECT job_id, CAST(seq AS INT) AS seq, stage, NOT EXISTS (SELECT 1 FROM sp a WHERE a.job_id = p.job_id AND a.kind = 'answer' AND a.stage = p.stage AND a.seq < p.seq) AS paused FROM sp p WHERE kind = 'pause'")
def st9_pause_machine(t):
    kind = F.when(F.col("l_returnflag") == "A", "answer").when(F.col("l_returnflag") == "N", "pause").otherwise("run")
    rows = stream_of(t, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") % 3).alias("stage"), kind.alias("kind"),
        SECONDS("l_shipdate").alias("at"), "l_partkey", "l_suppkey", "l_extendedprice")
    return run_available(machines.pause_stream(rows, ["at", "l_partkey", "l_suppkey", "l_extendedprice"]))


@query("s6_diag_stream", "SELECT upper(event_type) AS kind, event_id % 2 AS file, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events WHERE event_id % 10 > 0 GROUP BY 1, 2")
def s6_diag_stream(t):
    # Two drops of JSON lines, a run after each; every tenth line is broken.
    queue, base = new_folder(t.spark), new_folder(t.spark)
    good = F.to_json(F.struct(F.upper("event_type").alias("kind"), F.col("user_id").cast("string").alias("username"),
                              (F.col("event_id") % 2).cast("string").alias("step"), F.col("props").alias("detail")))
    events = t("events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), "props")).otherwise(good).alias("value"))
    for half in (0, 1):
        events.filter(F.col("event_id") % 2 == half).select("value").write.mode("append").text(queue)
        out = deliver(read_queue(t.spark, queue, "*.txt"), base)
    return out.groupBy("kind", F.col("step").cast("bigint").alias("file")).agg(
        F.count("*").alias("n"), F.sum(F.col("username").cast("bigint")).alias("users"))
