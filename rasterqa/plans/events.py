"""Job, worker and generic aggregate queries over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterqa import dims
from rasterqa.functions.numbers import count_where, half_even, share_where
from rasterqa.operators import events as ev
from rasterqa.operators import ordered
from rasterqa.operators.joins import as_of
from rasterqa.plans.registry import query

DAY = 86400
EPOCH = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
SECONDS = lambda c: F.floor(EPOCH(c) / 1000000).cast("bigint")


def events_s(t):
    """Events with whole-second stamps (floor)."""
    return t("events").select("event_id", "user_id", "event_type", "value", "props", SECONDS("ts").alias("ts"))


EVS = "evs AS MATERIALIZED (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000000 AS ts FROM events)"
CLOCK = "clock AS (SELECT max(ts) AS now FROM evs)"


def clock_of(t):
    return events_s(t).agg(F.max("ts").alias("now"))


def heartbeats(t):
    return events_s(t).select(
        F.col("user_id").alias("agent_id"), (F.col("user_id") % 50).alias("username"), "ts", "event_id",
        (F.col("event_type") != "error").alias("logged_in"))


def jobs(t):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return t("orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("cust"),
        F.when(F.col("o_custkey") % 97 == 0, "").otherwise((F.col("o_custkey") % 50).cast("string")).alias("created_by"),
        SECONDS("o_orderdate").alias("created_at"), status.alias("status"),
        F.when(status == "running", F.col("o_custkey") % 150).alias("claimed_by"),
        F.lit(1704067200).cast("bigint").alias("base"), "o_orderpriority")


JOBS = ("jb AS MATERIALIZED (SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 97 = 0 THEN '' ELSE (o_custkey % 50)::VARCHAR END AS created_by, "
        "epoch_us(o_orderdate) // 1000000 AS created_at, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, "
        "CASE WHEN o_orderstatus = 'P' THEN o_custkey % 150 END AS claimed_by, o_orderpriority FROM orders)")
# Event gaps run to hours, so the presence window is three hours here, the grace six.
WINDOW, GRACE = 3 * 3600, 6 * 3600
ONLINE = (f"la AS (SELECT user_id AS agent_id, max(ts) AS last_seen, arg_max(event_type <> 'error', (ts, event_type <> 'error')) AS logged_in FROM evs GROUP BY user_id), "
          f"onl AS MATERIALIZED (SELECT agent_id, agent_id % 50 AS username, last_seen, logged_in FROM la, clock WHERE now - last_seen <= {WINDOW} "
          f"OR (now - last_seen <= {GRACE} AND agent_id IN (SELECT claimed_by FROM jb WHERE status = 'running')))")
BUSY = "bz AS (SELECT DISTINCT claimed_by AS agent_id FROM jb WHERE status = 'running' AND claimed_by % 3 = 0)"
BASE = f"{EVS}, {CLOCK}, {JOBS}, {ONLINE}"


def online(t):
    return ev.online_agents(heartbeats(t), jobs(t), clock_of(t), WINDOW, GRACE)


def busy(t):
    """A third of the workers hold a job, so free and busy ones both occur."""
    return ev.busy_agents(jobs(t).filter("claimed_by % 3 = 0"))


@query("e1_online_agents", f"WITH {BASE} SELECT * FROM onl")
def e1_online_agents(t):
    return online(t).select("agent_id", "username", "last_seen", "logged_in")


@query("e1_online_agents_90s", f"WITH {EVS}, {CLOCK}, {JOBS}, la AS (SELECT user_id AS agent_id, max(ts) AS last_seen FROM evs GROUP BY 1) SELECT agent_id, last_seen FROM la, clock WHERE now - last_seen <= 90 OR (now - last_seen <= 300 AND agent_id IN (SELECT claimed_by FROM jb))")
def e1_online_agents_90s(t):
    return ev.online_agents(heartbeats(t), jobs(t), clock_of(t)).select("agent_id", "last_seen")


@query("e2_busy_agents", f"WITH {JOBS} SELECT DISTINCT claimed_by AS agent_id FROM jb WHERE status = 'running'")
def e2_busy_agents(t):
    return ev.busy_agents(jobs(t))


@query("e3_user_status", f"WITH {BASE}, {BUSY} SELECT username, count(*) AS agents, count(bz.agent_id) AS busy, bool_or(bz.agent_id IS NULL) AS has_free, bool_or(logged_in) AS logged_in, arg_max(onl.agent_id, (logged_in, last_seen, onl.agent_id)) AS label_agent FROM onl LEFT JOIN bz USING (agent_id) GROUP BY username")
def e3_user_status(t):
    return ev.user_status(online(t), busy(t))


@query("j1_user_fleet", f"WITH {BASE}, nw AS (SELECT username, max(last_seen) AS ls FROM onl GROUP BY username) SELECT c_custkey AS username, ls IS NOT NULL AS agent_online, ls AS agent_last_seen FROM customer LEFT JOIN nw ON username = c_custkey")
def j1_user_fleet(t):
    users = t("customer").select(F.col("c_custkey").alias("username"))
    return ev.user_fleet(users, online(t))


@query("j2_token_fleet", f"WITH {BASE} SELECT s_suppkey AS token_id, onl.agent_id IS NOT NULL AS online FROM supplier LEFT JOIN onl ON onl.agent_id = s_suppkey")
def j2_token_fleet(t):
    up = online(t).select(F.col("agent_id").alias("token_id"), F.lit(True).alias("up"))
    return t("supplier").select(F.col("s_suppkey").alias("token_id")).join(up, "token_id", "left").select(
        "token_id", F.coalesce("up", F.lit(False)).alias("online"))


@query("j3_resolve_identity", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON sha256('agt_' || s_suppkey) = sha256('agt_' || c_custkey) WHERE c_acctbal >= 0")
def j3_resolve_identity(t):
    tokens = t("supplier").select("s_suppkey", F.sha2(F.concat(F.lit("agt_"), "s_suppkey"), 256).alias("token"))
    users = t("customer").filter("c_acctbal >= 0").select(
        "c_custkey", F.sha2(F.concat(F.lit("agt_"), F.col("c_custkey")), 256).alias("token"))
    return tokens.join(users, "token").select("s_suppkey", "c_custkey")


_CLAIM = "fr AS (SELECT * FROM onl WHERE agent_id NOT IN (SELECT agent_id FROM bz)), cl AS (SELECT * FROM jb WHERE status = 'queued' AND (created_by IN (SELECT username::VARCHAR FROM fr) OR (created_by = '' AND (SELECT count(*) FROM fr) > 0)))"


def _claimable(t):
    up = online(t).withColumn("username", F.col("username").cast("string"))
    return ev.claimable_jobs(jobs(t), up, busy(t))


@query("j4_claimable_jobs", f"WITH {BASE}, {BUSY}, {_CLAIM} SELECT job_id, created_by FROM cl")
def j4_claimable_jobs(t):
    return _claimable(t).select("job_id", "created_by")


@query("w1_next_job", f"WITH {BASE}, {BUSY}, {_CLAIM} SELECT created_by, job_id, created_at FROM cl QUALIFY row_number() OVER (PARTITION BY created_by ORDER BY created_at, job_id) = 1")
def w1_next_job(t):
    return ev.next_jobs(_claimable(t))


@query("j5_orphaned_jobs", f"WITH {BASE} SELECT job_id, claimed_by FROM jb WHERE status = 'running' AND claimed_by NOT IN (SELECT agent_id FROM onl)")
def j5_orphaned_jobs(t):
    return ev.orphaned_jobs(jobs(t), online(t)).select("job_id", "claimed_by")


@query("e4_requeue", f"""WITH {BASE} SELECT job_id, CASE WHEN now - (now - job_id % 600) > 300 AND job_id % 7 > 0 THEN 'agent silent > 300s' ELSE 'owning agent went offline' END AS reason FROM jb, clock
 WHERE status = 'running' AND ((job_id % 600 > 300 AND job_id % 7 > 0) OR claimed_by NOT IN (SELECT agent_id FROM onl))""")
def e4_requeue(t):
    # Last progress lies job_id % 600 seconds back; every seventh job awaits input.
    held = ev.with_now(jobs(t), clock_of(t)).select(
        "*", (F.col("now") - F.col("job_id") % 600).alias("last_progress"), (F.col("job_id") % 7 == 0).alias("awaiting_input")).drop("now")
    return ev.requeue(held, online(t), clock_of(t)).select("job_id", "reason")


@query("e5_job_heartbeats", f"WITH {EVS} SELECT l_orderkey * 10 + l_linenumber AS job_id, user_id AS agent_id, count(*) AS beats FROM lineitem JOIN evs ON user_id = l_partkey % 150 AND evs.ts BETWEEN 1704067200 + (l_orderkey % 30) * 86400 AND 1704067200 + (l_orderkey % 30) * 86400 + l_quantity * 360 GROUP BY ALL")
def e5_job_heartbeats(t):
    start = F.lit(1704067200) + F.col("l_orderkey") % 30 * DAY
    held = t("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("job_id"), (F.col("l_partkey") % 150).alias("agent_id"),
        start.alias("start"), (start + F.col("l_quantity") * 360).cast("bigint").alias("stop"))
    return ev.job_heartbeats(held, heartbeats(t), 6 * 3600).groupBy("job_id", "agent_id").agg(F.count("*").alias("beats"))


_LIMITS = " ".join(f"WHEN contains(step, '{n}') THEN {s}" for n, s in dims.STEP_LIMITS)


@query("e6_stalls", f"""WITH {EVS}, {CLOCK}, st AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'click' THEN 'upload file' WHEN 'view' THEN 'detect objects' ELSE event_type END AS step,
 CASE WHEN event_type = 'signup' THEN 'awaiting_selection' ELSE 'running' END AS status FROM evs),
 pv AS (SELECT *, lag(step) OVER w AS ps, lag(status) OVER w AS pt FROM st WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
 nu AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> step OR status LIKE 'awaiting%' OR pt LIKE 'awaiting%' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS step_no FROM pv),
 sp AS (SELECT job_id, CAST(step_no AS BIGINT) AS step_no, min(ts) AS since, arg_min(step, (ts, event_id)) AS step, arg_min(status, (ts, event_id)) AS status FROM nu GROUP BY job_id, step_no),
 cl AS (SELECT *, coalesce(lead(since) OVER (PARTITION BY job_id ORDER BY step_no), now) - since AS stuck_s, CAST(CASE {_LIMITS} ELSE 300 END AS INT) AS limit_s FROM sp, clock)
 SELECT job_id, step_no, step, since, limit_s, stuck_s FROM cl WHERE stuck_s >= limit_s AND status NOT LIKE 'awaiting%'""")
def e6_stalls(t):
    step = F.when(F.col("event_type") == "click", "upload file").when(F.col("event_type") == "view", "detect objects").otherwise(F.col("event_type"))
    rows = events_s(t).select(
        F.col("user_id").alias("job_id"), "event_id", "ts", step.alias("step"),
        F.when(F.col("event_type") == "signup", "awaiting_selection").otherwise("running").alias("status"))
    return ev.stalls(rows, clock_of(t))


def calls(t):
    return events_s(t).select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), "ts")


# Accepted calls of each key, one call per recursion step: the limiter spelled out.
@query("e7_rate_limit", f"""WITH RECURSIVE {EVS}, cs AS MATERIALIZED (SELECT user_id AS key, event_id AS call_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM evs),
 fold AS (SELECT key, call_id, rn, TRUE AS accepted, [ts] AS kept FROM cs WHERE rn = 1
 UNION ALL SELECT c.key, c.call_id, c.rn, len(list_filter(f.kept, lambda k: c.ts - k <= {DAY})) < 2,
 CASE WHEN len(list_filter(f.kept, lambda k: c.ts - k <= {DAY})) < 2 THEN list_append(list_filter(f.kept, lambda k: c.ts - k <= {DAY}), c.ts) ELSE list_filter(f.kept, lambda k: c.ts - k <= {DAY}) END
 FROM fold f JOIN cs c ON c.key = f.key AND c.rn = f.rn + 1) SELECT key, call_id, accepted FROM fold""")
def e7_rate_limit(t):
    # Two calls a day instead of sixty a minute: gaps in the table are hours long.
    return ev.rate_limit(calls(t), n=2, window=DAY)


@query("e8_lockouts", f"""WITH RECURSIVE {EVS}, cs AS MATERIALIZED (SELECT user_id AS key, event_id AS attempt_id, ts, event_type IN ('purchase', 'signup') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM evs),
 fold AS (SELECT key, 0::BIGINT AS rn, 0::BIGINT AS attempt_id, 'none' AS outcome, 0 AS n, 0::BIGINT AS until FROM (SELECT DISTINCT key FROM cs)
 UNION ALL SELECT c.key, c.rn, c.attempt_id, CASE WHEN f.until > c.ts THEN 'refused' WHEN c.ok THEN 'success' WHEN (CASE WHEN f.until > 0 THEN 0 ELSE f.n END) + 1 >= 5 THEN 'locked' ELSE 'failure' END,
 CASE WHEN f.until > c.ts THEN f.n WHEN c.ok THEN 0 ELSE (CASE WHEN f.until > 0 THEN 0 ELSE f.n END) + 1 END,
 CASE WHEN f.until > c.ts THEN f.until WHEN c.ok THEN 0 WHEN (CASE WHEN f.until > 0 THEN 0 ELSE f.n END) + 1 >= 5 THEN c.ts + {DAY} ELSE 0 END
 FROM fold f JOIN cs c ON c.key = f.key AND c.rn = f.rn + 1) SELECT key, attempt_id, outcome FROM fold WHERE rn > 0""")
def e8_lockouts(t):
    tries = events_s(t).select(F.col("user_id").alias("key"), F.col("event_id").alias("attempt_id"), "ts",
                               F.col("event_type").isin("purchase", "signup").alias("ok"))
    return ev.lockouts(tries, seconds=DAY)


_UPD = ("up AS (SELECT l_orderkey AS job_id, epoch_us(l_shipdate) // 1000000 AS ts, l_linenumber AS seq, CASE WHEN l_returnflag = 'A' AND l_discount > 0.08 THEN 'cancelled' WHEN l_linestatus = 'F' THEN 'done' "
        "WHEN l_returnflag = 'R' THEN 'failed' ELSE 'awaiting_selection' END AS status FROM lineitem)")


@query("e9_apply_status", f"WITH {_UPD} SELECT job_id, CASE WHEN bool_or(status = 'cancelled') THEN 'cancelled' ELSE coalesce(arg_max(status, (ts, seq, status)) FILTER (status IN ('done', 'failed')), 'running') END AS status FROM up GROUP BY job_id")
def e9_apply_status(t):
    status = (
        F.when((F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.08), "cancelled").when(F.col("l_linestatus") == "F", "done")
        .when(F.col("l_returnflag") == "R", "failed").otherwise("awaiting_selection"))
    updates = t("lineitem").select(F.col("l_orderkey").alias("job_id"), SECONDS("l_shipdate").alias("ts"),
                                   F.struct("l_linenumber", status.alias("s")).alias("seq"), status.alias("status"))
    return ev.final_status(updates)


@query("e10_validate_requests", f"""WITH rq AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 5 WHEN 0 THEN 'custom' WHEN 1 THEN 'artwork' WHEN 2 THEN '' WHEN 3 THEN 'mockup' ELSE 'geometry' END AS workflow, o_orderpriority AS p FROM orders),
 fl AS (SELECT *, CASE WHEN p LIKE '1%' THEN ' ' ELSE 'a.png' END AS artwork_files, CASE WHEN p LIKE '2%' THEN '' ELSE 'x' END AS custom_operations, CASE WHEN p LIKE '3%' THEN '' ELSE 'f' END AS files, '' AS options, NULL AS mockup_image FROM rq),
 ru AS (SELECT * FROM (VALUES {dims.values_sql([(i, *r) for i, r in enumerate(dims.WORKFLOW_RULES)])}) v(position, workflow, field, message)),
 hit AS (SELECT request_id, arg_min(message, position) AS message FROM fl JOIN ru USING (workflow) WHERE coalesce(trim(CASE field WHEN 'artwork_files' THEN artwork_files WHEN 'custom_operations' THEN custom_operations
 WHEN 'files' THEN files WHEN 'options' THEN options WHEN 'mockup_image' THEN mockup_image END), '') = '' GROUP BY request_id)
 SELECT request_id, workflow, message FROM fl LEFT JOIN hit USING (request_id)""")
def e10_validate_requests(t):
    k, p = F.col("o_orderkey") % 5, F.col("o_orderpriority")
    flow = F.when(k == 0, "custom").when(k == 1, "artwork").when(k == 2, "").when(k == 3, "mockup").otherwise("geometry")
    fields = F.create_map(
        F.lit("artwork_files"), F.when(p.startswith("1"), " ").otherwise("a.png"),
        F.lit("custom_operations"), F.when(p.startswith("2"), "").otherwise("x"),
        F.lit("files"), F.when(p.startswith("3"), "").otherwise("f"), F.lit("options"), F.lit(""))
    requests = t("orders").select(F.col("o_orderkey").alias("request_id"), flow.alias("workflow"), fields.alias("fields"))
    rules = dims.rows(t.spark, [(i, *r) for i, r in enumerate(dims.WORKFLOW_RULES)], "position int, workflow string, field string, message string")
    return ev.validate_requests(requests, rules)


@query("e12_job_number", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'AW-C' || (o_custkey % 90)::VARCHAR || '-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0')
 ELSE 'JOB-' || strftime(o_orderdate, '%Y%m%d') || '-' || upper(md5(o_orderkey::VARCHAR)[1:4]) END AS job_number,
 coalesce(nullif(trim(regexp_replace(trim(o_orderpriority), '[^A-Za-z0-9 ._-]+', '', 'g'), ' .'), ''), 'Unassigned') AS client FROM orders""")
def e12_job_number(t):
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(
        F.lit("aw-c"), F.col("o_custkey") % 90, F.lit("-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit("-SRC.jpg"))).otherwise("photo.png")
    number = ev.job_number(name, F.col("o_orderdate"), F.md5(F.col("o_orderkey").cast("string")))
    return t("orders").select("o_orderkey", number.alias("job_number"), ev.safe_client(F.col("o_orderpriority")).alias("client"))


@query("e13_error_ledger", f"""WITH {EVS}, er AS (SELECT user_id AS job_id, event_id, ts, event_type = 'error' AS is_error, event_type || ' ' || event_id AS message FROM evs WHERE event_type IN ('error', 'view'))
 SELECT job_id, count(*) FILTER (is_error) AS errors, count(*) FILTER (NOT is_error) AS warnings, arg_max(message, (ts, event_id)) FILTER (is_error) AS error,
 CASE WHEN count(*) FILTER (is_error) > 0 THEN 'failed' ELSE 'running' END AS status FROM er GROUP BY job_id""")
def e13_error_ledger(t):
    rows = events_s(t).filter(F.col("event_type").isin("error", "view")).select(
        F.col("user_id").alias("job_id"), "event_id", "ts", (F.col("event_type") == "error").alias("is_error"),
        F.concat("event_type", F.lit(" "), "event_id").alias("message"))
    return ev.error_ledger(rows)


_FIELDS = ("fd AS (SELECT l_orderkey AS job_id, l_linenumber AS field, CASE max(l_returnflag) WHEN 'A' THEN 'server' WHEN 'N' THEN 'worker' ELSE 'computed' END AS owner, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), "
           "cu AS (SELECT job_id, field, owner, q AS value FROM fd WHERE job_id % 3 < 2), inc AS (SELECT job_id, field, owner, CASE WHEN q > 25 THEN q + 100 END AS value FROM fd WHERE job_id % 3 > 0)")


@query("e14_merge_job_fields", f"""WITH {_FIELDS} SELECT job_id, field, coalesce(cu.owner, inc.owner) AS owner, CASE coalesce(cu.owner, inc.owner) WHEN 'server' THEN cu.value WHEN 'computed' THEN coalesce(inc.value, cu.value)
 ELSE CASE WHEN inc.job_id IS NOT NULL THEN inc.value ELSE cu.value END END AS value FROM cu FULL JOIN inc USING (job_id, field) WHERE cu.owner IS NOT NULL OR inc.owner <> 'server'""")
def e14_merge_job_fields(t):
    owner = F.max("l_returnflag")
    base = t("lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("field")).agg(
        F.when(owner == "A", "server").when(owner == "N", "worker").otherwise("computed").alias("owner"), F.max("l_quantity").alias("value"))
    now = base.filter("job_id % 3 < 2")
    new = base.filter("job_id % 3 > 0").withColumn("value", F.when(F.col("value") > 25, F.col("value") + 100))
    return ev.merge_job_fields(now, new)


@query("j14_full_outer_merge", f"WITH {_FIELDS} SELECT coalesce(cu.job_id, inc.job_id) AS job_id, count(cu.value) AS current_fields, count(*) FILTER (inc.job_id IS NOT NULL) AS incoming_fields FROM cu FULL JOIN inc ON cu.job_id = inc.job_id AND cu.field = inc.field GROUP BY 1")
def j14_full_outer_merge(t):
    base = t("lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("field")).agg(F.max("l_quantity").alias("v"))
    now = base.filter("job_id % 3 < 2").withColumnRenamed("v", "cv")
    new = base.filter("job_id % 3 > 0").select("job_id", "field", F.lit(1).alias("iv"))
    return now.join(new, ["job_id", "field"], "full_outer").groupBy("job_id").agg(
        F.count("cv").alias("current_fields"), F.count("iv").alias("incoming_fields"))


@query("e15_public_jobs", """SELECT o_orderkey AS job_id, string_agg(f, ',' ORDER BY l_linenumber, l_partkey, f) AS files FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey, printf('%d_%d.png', l_orderkey, l_linenumber) AS f
 FROM lineitem WHERE l_linestatus = 'F') ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey""")
def e15_public_jobs(t):
    files = t("lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", F.format_string("%d_%d.png", "l_orderkey", "l_linenumber").alias("f"), "l_linestatus"))).alias("all"))
    landed = F.transform(F.filter("all", lambda s: s["l_linestatus"] == "F"), lambda s: s["f"])
    record = F.create_map(F.lit("_regenerate"), F.lit("1"), F.lit("status"), F.col("o_orderstatus"))
    public = t("orders").withColumn("rec", F.map_filter(record, lambda k, v: ~k.startswith("_"))).filter(F.col("rec")["status"] != "P")
    return public.select(F.col("o_orderkey").alias("job_id")).join(files, "job_id", "left").select(
        "job_id", F.when(F.size(landed) > 0, F.array_join(landed, ",")).alias("files"))


@query("e16_version_at_least", """WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1.' || (p_size % 12)::VARCHAR || '.0' WHEN 1 THEN '1.7.' || (p_size % 3)::VARCHAR WHEN 2 THEN 'unknown' ELSE '2.' || p_size::VARCHAR END AS version FROM part)
 SELECT p_partkey, version, version <> 'unknown' AND CASE WHEN version LIKE '2%' THEN TRUE WHEN version LIKE '1%' THEN CAST(split_part(version, '.', 2) AS INT) >= 7 ELSE FALSE END AS ok FROM v""")
def e16_version_at_least(t):
    k = F.col("p_partkey") % 4
    version = (
        F.when(k == 0, F.concat(F.lit("1."), F.col("p_size") % 12, F.lit(".0"))).when(k == 1, F.concat(F.lit("1.7."), F.col("p_size") % 3))
        .when(k == 2, "unknown").otherwise(F.concat(F.lit("2."), "p_size")))
    return t("part").select("p_partkey", version.alias("version"), ev.version_at_least(version, "1.7.0").alias("ok"))


@query("e17_ordered_operations", f"""WITH od AS (SELECT * FROM (VALUES {dims.values_sql(list(enumerate(dims.OPERATION_ORDER)))}) v(position, operation)),
 ch AS (SELECT DISTINCT p_partkey AS request_id, operation, position FROM part, od WHERE (p_size + position * 3) % 4 = 0)
 SELECT request_id, string_agg(operation, ',' ORDER BY position) AS operations FROM ch GROUP BY request_id""")
def e17_ordered_operations(t):
    order = dims.rows(t.spark, list(enumerate(dims.OPERATION_ORDER)), "position int, operation string")
    wanted = F.filter(F.array(*[F.when((F.col("p_size") + i * 3) % 4 == 0, o) for i, o in enumerate(dims.OPERATION_ORDER)]), lambda o: o.isNotNull())
    chosen = t("part").select(F.col("p_partkey").alias("request_id"), F.explode(wanted).alias("operation"))
    return ev.ordered_operations(chosen, order)


# ---- joins -------------------------------------------------------------------------

@query("j10_as_of_versions", """WITH vs AS (SELECT l_suppkey % 40 AS tkey, epoch_us(l_shipdate) // 1000000 AS valid_from, max(l_orderkey) AS version FROM lineitem GROUP BY 1, 2),
 jb AS (SELECT o_orderkey AS job_id, o_custkey % 40 AS tkey, epoch_us(o_orderdate) // 1000000 AS created FROM orders)
 SELECT job_id, version, valid_from AS valid_from_used FROM jb ASOF LEFT JOIN vs ON vs.tkey = jb.tkey AND vs.valid_from <= jb.created""")
def j10_as_of_versions(t):
    versions = t("lineitem").groupBy((F.col("l_suppkey") % 40).alias("tkey"), SECONDS("l_shipdate").alias("valid_from")).agg(
        F.max("l_orderkey").alias("version"))
    made = t("orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 40).alias("tkey"), SECONDS("o_orderdate").alias("created"))
    return as_of(made, versions, "tkey", "created", "valid_from", ["version"], 30 * DAY).select("job_id", "version", "valid_from_used")


# ---- aggregates --------------------------------------------------------------------

@query("a1_rate", "SELECT l_returnflag, round_even(avg(CAST(l_discount > 0.05 AS INT)), 4) AS rate, count(*) FILTER (l_discount > 0.05) AS n FROM lineitem GROUP BY 1")
def a1_rate(t):
    hit = F.col("l_discount") > 0.05
    return t("lineitem").groupBy("l_returnflag").agg(half_even(share_where(hit), 4).alias("rate"), count_where(hit).alias("n"))


@query("a2_percentiles", "SELECT l_returnflag, " + ", ".join(f"round_even(quantile_cont(l_quantity, {p}), 4) AS p{int(p * 100)}" for p in (0.01, 0.05, 0.1, 0.5)) + " FROM lineitem GROUP BY 1")
def a2_percentiles(t):
    return t("lineitem").groupBy("l_returnflag").agg(*[
        half_even(F.percentile("l_quantity", p), 4).alias(f"p{int(p * 100)}") for p in (0.01, 0.05, 0.1, 0.5)])


@query("a4_moments", "SELECT l_linestatus, min(l_quantity) AS lo, max(l_quantity) AS hi, round_even(avg(l_quantity), 4) AS mean, round_even(stddev_pop(l_quantity), 4) AS sd FROM lineitem GROUP BY 1")
def a4_moments(t):
    return t("lineitem").groupBy("l_linestatus").agg(
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), half_even(F.avg("l_quantity"), 4).alias("mean"),
        half_even(F.stddev_pop("l_quantity"), 4).alias("sd"))


@query("a5_distinct_users", "SELECT event_type, user_id FROM events GROUP BY ALL")
def a5_distinct_users(t):
    # One row per user rather than one set per type: a set would sit in one task.
    return t("events").select("event_type", "user_id").distinct()


@query("a6_status_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def a6_status_counts(t):
    counted = t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["O", "P", "F"]).count()
    return counted.select("o_orderpriority", *[F.coalesce(F.col(a), F.lit(0)).cast("bigint").alias(b) for a, b in (("O", "queued"), ("P", "running"), ("F", "done"))])


@query("a7_loop_summary", f"WITH {EVS} SELECT ts // 300 * 300 AS slot, count(*) AS polls, count(*) FILTER (event_type = 'view') AS idle, count(*) FILTER (event_type = 'purchase') AS jobs, count(*) FILTER (event_type = 'error') AS errors FROM evs GROUP BY 1")
def a7_loop_summary(t):
    from rasterqa.streaming.queries import loop_summary

    return loop_summary(t("events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("a8_active_time", f"WITH {EVS}, nx AS (SELECT user_id AS job_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS d FROM evs) SELECT job_id, CAST(coalesce(sum(d) FILTER (event_type <> 'view'), 0) AS BIGINT) AS active_s FROM nx GROUP BY job_id")
def a8_active_time(t):
    rows = events_s(t).select(F.col("user_id").alias("job_id"), "event_id", "ts", "event_type")
    marked = ordered.previous_row(rows, "job_id", ["ts", "event_id"], ["ts", "event_type"], 30 * DAY)
    spent = F.when(F.col("prev.event_type") != "view", F.col("ts") - F.col("prev.ts"))
    return marked.groupBy("job_id").agg(F.coalesce(F.sum(spent), F.lit(0)).cast("bigint").alias("active_s"))


@query("a9_run_latency", "SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (l_linestatus = 'F') AS success, CAST(min(epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000 AS BIGINT) AS min_ms, CAST(max(epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000 AS BIGINT) AS max_ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def a9_run_latency(t):
    joined = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    ms = F.floor((EPOCH("l_shipdate") - EPOCH("o_orderdate")) / 1000).cast("bigint")
    return joined.groupBy("o_orderpriority").agg(
        F.count("*").alias("runs"), count_where(F.col("l_linestatus") == "F").alias("success"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))


@query("a10_latest_by", f"WITH {EVS} SELECT user_id, max(ts) AS last_seen, arg_max(event_type, (ts, event_type, value)) AS event_type FROM evs GROUP BY 1")
def a10_latest_by(t):
    return ev.latest_by(events_s(t), "user_id", "ts", ["event_type", "value"]).select("user_id", "last_seen", "event_type")


@query("a11_mode_share", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, arg_max(p_type, (n, p_type)) AS top_type, round_even(max(n) / sum(n), 3) AS share FROM c GROUP BY 1")
def a11_mode_share(t):
    counts = t("part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return counts.groupBy("p_brand").agg(
        F.max_by("p_type", F.struct("n", "p_type")).alias("top_type"), half_even(F.max("n") / F.sum("n"), 3).alias("share"))


# ---- windows, sorts, limits, sets --------------------------------------------------

@query("w2_state_changes", f"WITH {EVS}, pv AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM evs) SELECT user_id, count(*) FILTER (p IS NULL OR p <> event_type) AS changes, count(*) FILTER (p = event_type) AS repeats FROM pv GROUP BY 1")
def w2_state_changes(t):
    marked = ordered.previous_row(events_s(t), "user_id", ["ts", "event_id"], ["event_type"], 30 * DAY)
    same = F.coalesce(F.col("prev.event_type") == F.col("event_type"), F.lit(False))
    return marked.groupBy("user_id").agg(count_where(~same).alias("changes"), count_where(same).alias("repeats"))


@query("w3_last_n", f"WITH {EVS} SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS rn FROM evs QUALIFY rn <= 20")
def w3_last_n(t):
    return ordered.last_n(events_s(t), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id", "rn")


@query("w4_gaps", f"WITH {EVS} SELECT event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_s FROM evs")
def w4_gaps(t):
    marked = ordered.previous_row(events_s(t), "user_id", ["ts", "event_id"], ["ts"], 30 * DAY)
    return marked.select("event_id", (F.col("ts") - F.col("prev.ts")).alias("gap_s"))


@query("w5_trailing_count", f"WITH {EVS} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS last_minute, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS last_day FROM evs")
def w5_trailing_count(t):
    minute = ordered.trailing_count(events_s(t), "user_id", "ts", 60, "last_minute", 3600)
    return ordered.trailing_count(minute, "user_id", "ts", DAY, "last_day", 10 * DAY).select("event_id", "last_minute", "last_day")


@query("w6_version_rank", "SELECT l_orderkey, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS version FROM lineitem")
def w6_version_rank(t):
    win = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(win).alias("version"))


_STEPS = ("sp AS (SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS seq, l_linenumber % 3 AS stage, "
          "CASE l_returnflag WHEN 'A' THEN 'answer' WHEN 'N' THEN 'pause' ELSE 'run' END AS kind FROM lineitem)")


def steps(t):
    win = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "A", "answer").when(F.col("l_returnflag") == "N", "pause").otherwise("run")
    return t("lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.row_number().over(win).alias("seq"), (F.col("l_linenumber") % 3).alias("stage"), kind.alias("kind"))


@query("w7_pause_transitions", f"WITH {_STEPS} SELECT job_id, CAST(seq AS INT) AS seq, stage, NOT EXISTS (SELECT 1 FROM sp a WHERE a.job_id = p.job_id AND a.kind = 'answer' AND a.stage = p.stage AND a.seq < p.seq) AS paused FROM sp p WHERE kind = 'pause'")
def w7_pause_transitions(t):
    return ev.pause_transitions(steps(t))


@query("w8_weighted_rank", "WITH s AS (SELECT p_brand, p_name, sum(p_size) AS w FROM part GROUP BY 1, 2) SELECT p_brand, p_name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY w DESC, p_name) AS INT) AS rank FROM s QUALIFY rank <= 5")
def w8_weighted_rank(t):
    sums = t("part").groupBy("p_brand", "p_name").agg(F.sum("p_size").alias("w"))
    return ordered.last_n(sums, "p_brand", [F.desc("w"), F.asc("p_name")], 5).select("p_brand", "p_name", F.col("rn").alias("rank"))


@query("o1_sort", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY lower(o_orderpriority), o_orderdate DESC, o_orderkey")
def o1_sort(t):
    return t("orders").orderBy(F.lower("o_orderpriority"), F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("o2_top_k", f"WITH {EVS} SELECT event_id, user_id, event_type FROM evs WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1000")
def o2_top_k(t):
    limit = max(1, min(5000, 1000))
    return events_s(t).filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).select("event_id", "user_id", "event_type")
