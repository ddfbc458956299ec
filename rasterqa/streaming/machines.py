"""Keyed state machines for streams: presence, stalls, limits, pauses, changes.

Each keeps a few typed values per key in the RocksDB state store. A key's rows of one
micro-batch are put in event order before they are applied, so a micro-batch bounds what a
task holds of a hot key (``read_stream(..., max_files)``). State ends by event-time timers:
they follow the watermark, so a replay forgets at the same rows as the first run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterqa import dims

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """A machine over one key's rows: ``by`` orders them, ``take`` are the columns it reads."""

    by: list[str]
    take: list[str]
    out: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def in_order(self, pdfs: Iterator[pd.DataFrame]):
        wanted = list(dict.fromkeys([*self.take, *self.by]))
        rows = pd.concat([p[wanted] for p in pdfs], ignore_index=True).sort_values(self.by, kind="stable")
        return rows[self.take].itertuples(index=False, name=None)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in self.out.split(", ")])

    def wake_at(self, ms: int | None) -> None:
        """The key's only timer; None: none."""
        timers = list(self.handle.listTimers())
        for t in timers:
            if t != ms:
                self.handle.deleteTimer(t)
        if ms is not None and ms not in timers:
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, machine: Machine, timers: bool) -> DataFrame:
    rows.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    return rows.groupBy(key).transformWithStateInPandas(machine, machine.out, "append", "EventTime" if timers else "None")


class _Changes(Machine):
    by, out = ["tick", "modified_ms"], "path string, tick bigint, etag string, modified_ms bigint, is_new boolean"

    def __init__(self, memory: int | None, first_tick: int, keep_s: int | None) -> None:
        self.memory, self.first_tick, self.keep_s = memory, first_tick, keep_s
        self.take = ["tick", "etag", "modified_ms"] + (["event_time"] if keep_s is not None else [])

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "etag string, tick bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, seen = self.last.get() if self.last.exists() else (None, None)
        found, newest = [], None
        read = list(self.in_order(rows))
        for (tick, etag, ms, *at), later in zip(read, [*read[1:], None]):
            newest = max(at + ([] if newest is None else [newest]), default=None)
            if later is not None and later[0] == tick:
                continue  # a tick shows the newest version only
            if seen is not None and tick <= seen:
                continue
            forgotten = seen is None or (self.memory is not None and tick - seen > self.memory)
            if forgotten or etag != known:
                found.append((key[0], tick, etag, ms, tick > self.first_tick))
            known, seen = etag, int(tick)
        self.last.update((known, seen))
        if newest is not None:
            due = int(newest.timestamp() * 1000) + self.keep_s * 1000
            self.wake_at(max([due, *self.handle.listTimers()]))
        yield self.frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield self.frame([])


def change_stream(ticks: DataFrame, memory: int | None = None, first_tick: int = 0, keep_s: int | None = None) -> DataFrame:
    """Entries whose etag differs from the last one seen for their path.

    Rows of ticks that are over for the path come too late and are left out. An etag counts as
    seen for ``memory`` ticks (None: as long as state lives); a tick reads the vault again some time
    back (``changes.poll_ticks``), and that overlap publishes nothing twice. What the first tick finds is
    history: ``is_new`` is false. With ``keep_s``, ``ticks`` has ``event_time`` with a watermark, and a
    path's state goes once the watermark is ``keep_s`` past its newest row.
    """
    return _run(ticks, "path", _Changes(memory, first_tick, keep_s), keep_s is not None)


class _Presence(Machine):
    by, take, out = ["ts"], ["ts"], "agent_id bigint, ts bigint, state string"

    def __init__(self, limit_s: int) -> None:
        self.limit_s = limit_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        found = []
        for (ts,) in self.in_order(rows):
            if last is not None and ts - last > self.limit_s:
                found.append((key[0], last + self.limit_s, "offline"))
            if last is None or ts - last > self.limit_s:
                found.append((key[0], ts, "online"))
            last = ts if last is None else max(ts, last)
        self.last.update((int(last),))
        self.wake_at((int(last) + self.limit_s) * 1000)
        yield self.frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield self.frame([(key[0], last + self.limit_s, "offline")])


def presence_stream(heartbeats: DataFrame, limit_s: int = dims.ONLINE_WINDOW_S) -> DataFrame:
    """``online`` when a worker appears, ``offline`` once it has been silent too long.

    ``heartbeats(agent_id, ts, event_time)`` with a watermark on ``event_time``; a timer
    reports workers that never come back and ends their state.
    """
    return _run(heartbeats, "agent_id", _Presence(limit_s), True)


def limit_for(step: str) -> int:
    low = (step or "").lower()
    return next((s for needle, s in dims.STEP_LIMITS if needle in low), dims.DEFAULT_STEP_LIMIT)


class _Stalls(Machine):
    by, take = ["ts", "event_id"], ["ts", "step", "status"]
    out = "job_id bigint, step string, since bigint, limit_s int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.clock = handle.getValueState("clock", "step string, since bigint, warned boolean, paused boolean")

    def alert(self, key, found, step, since, warned, paused, now) -> bool:
        if step is not None and not warned and not paused and now - since >= limit_for(step):
            found.append((key[0], step, since, limit_for(step)))
            return True
        return warned

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        step, since, warned, paused = self.clock.get() if self.clock.exists() else (None, 0, False, False)
        found = []
        for ts, named, status in self.in_order(rows):
            waiting = status.startswith("awaiting_")
            warned = self.alert(key, found, step, since, warned, paused, int(ts))
            if step != named or waiting or paused:
                step, since, warned = named, int(ts), False
            paused = waiting
        self.clock.update((step, since, bool(warned), bool(paused)))
        self.wake_at(None if warned or paused else (since + limit_for(step)) * 1000)
        yield self.frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, since, warned, paused = self.clock.get()
        found = []
        warned = self.alert(key, found, step, since, warned, paused, since + limit_for(step))
        self.clock.update((step, since, bool(warned), bool(paused)))
        yield self.frame(found)


def stall_stream(events: DataFrame) -> DataFrame:
    """One alert per step that outlives its limit; a pause restarts the clock.

    ``events(job_id, event_id, ts, step, status, event_time)`` with a watermark; the
    alert comes from the next row or from the timer, whichever is first.
    """
    return _run(events, "job_id", _Stalls(), True)


class _Limit(Machine):
    by, take, out = ["ts", "call_id"], ["call_id", "ts"], "key bigint, call_id bigint, accepted boolean"

    def __init__(self, n: int, window: int) -> None:
        self.n, self.window = n, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getListState("kept", "ts bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [t for (t,) in self.kept.get()] if self.kept.exists() else []
        found = []
        for call_id, ts in self.in_order(rows):
            kept = [k for k in kept if ts - k <= self.window]
            ok = len(kept) < self.n
            if ok:
                kept.append(int(ts))
            found.append((key[0], call_id, ok))
        if kept:
            self.kept.put([(t,) for t in kept])
            self.wake_at((max(kept) + self.window) * 1000)
        else:
            self.kept.clear()
            self.wake_at(None)
        yield self.frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield self.frame([])


def limit_stream(calls: DataFrame, n: int = dims.RATE_LIMIT, window: int = dims.RATE_WINDOW_S) -> DataFrame:
    """Accept or reject each call of ``calls(key, call_id, ts, event_time)`` with a watermark.

    The state is the accepted times still in the window, never more than ``n``; it goes once the
    watermark has passed the window of the last one, when it can decide nothing any more.
    """
    return _run(calls, "key", _Limit(n, window), True)


class _Lockout(Machine):
    by, take, out = ["ts", "attempt_id"], ["attempt_id", "ts", "ok"], "key bigint, attempt_id bigint, outcome string"

    def __init__(self, failures: int, seconds: int) -> None:
        self.failures, self.seconds = failures, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lock = handle.getValueState("lock", "count bigint, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, until = self.lock.get() if self.lock.exists() else (0, 0)
        found = []
        for attempt, ts, ok in self.in_order(rows):
            if until and ts >= until:
                count, until = 0, 0
            if until:
                outcome = "refused"
            elif ok:
                count, outcome = 0, "success"
            else:
                count += 1
                until = int(ts) + self.seconds if count >= self.failures else 0
                outcome = "locked" if until else "failure"
            found.append((key[0], attempt, outcome))
        if count or until:
            self.lock.update((int(count), int(until)))
        else:
            self.lock.clear()
        self.wake_at(until * 1000 if until else None)
        yield self.frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.lock.clear()
        yield self.frame([])


def lockout_stream(attempts: DataFrame, failures: int = dims.LOCKOUT_FAILURES,
                   seconds: int = dims.LOCKOUT_SECONDS) -> DataFrame:
    """Outcome of each attempt of ``attempts(key, attempt_id, ts, ok, event_time)`` with a watermark.

    State is the failure count and the end of the lock. A lock ends with the watermark, a success leaves
    nothing behind; only keys that have failed without being locked stay, as the rule has no end for them.
    """
    return _run(attempts, "key", _Lockout(failures, seconds), True)


PAUSES = "job_id bigint, seq int, stage int, paused boolean"
PAUSE_STATE = "job array<bigint>, seq array<int>, due array<bigint>, answered_job array<bigint>, answered_stage array<int>"
#: Groups that jobs are dealt to: a call each for millions of short jobs costs more than their rows.
JOB_GROUPS = 1024


def _pauses(order: list[str], keep_s: int | None):
    """The pause machine over all jobs of a group at once; group -1 holds the rows without a job."""
    def frames(state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame]:
        job, seq, due, a_job, a_stage = [list(v) for v in state.get] if state.exists else ([], [], [], [], [])
        return (pd.DataFrame({"job_id": job, "seq": seq, "due": due}, dtype="int64"),
                pd.DataFrame({"job_id": a_job, "stage": a_stage}, dtype="int64"))

    def keep(state: GroupState, jobs: pd.DataFrame, answered: pd.DataFrame) -> None:
        if keep_s is not None:
            jobs = jobs[jobs.due > state.getCurrentWatermarkMs()]
            answered = answered[answered.job_id.isin(jobs.job_id)]
            if not len(jobs):
                if state.exists:
                    state.remove()
                return
        state.update((*(jobs[c].tolist() for c in ("job_id", "seq", "due")), *(answered[c].tolist() for c in ("job_id", "stage"))))
        if keep_s is not None:
            state.setTimeoutTimestamp(int(jobs.due.min()))

    def run(key, pdfs, state: GroupState) -> Iterator[pd.DataFrame]:
        jobs, answered = frames(state)
        if state.hasTimedOut:
            keep(state, jobs, answered)
            return
        rows = pd.concat(list(pdfs), ignore_index=True)
        if key[0] < 0:
            rows["job_id"] = 0
        rows = rows.sort_values(["job_id", *order], kind="stable", ignore_index=True)
        before = rows.job_id.map(jobs.set_index("job_id").seq).fillna(0).astype("int64")
        rows["seq"] = rows.groupby("job_id").cumcount() + 1 + before
        here = rows[rows.kind == "answer"].groupby(["job_id", "stage"], as_index=False).seq.min()
        firsts = pd.concat([answered.assign(seq=0), here.astype("int64")], ignore_index=True).groupby(
            ["job_id", "stage"], as_index=False).seq.min().rename(columns={"seq": "since"})
        found = rows.loc[rows.kind == "pause", ["job_id", "seq", "stage"]].merge(firsts, "left", ["job_id", "stage"])
        rows["due"] = 0 if keep_s is None else rows.event_time.astype("datetime64[ms]").astype("int64") + keep_s * 1000
        newest = rows.groupby("job_id", as_index=False).agg(seq=("seq", "max"), due=("due", "max"))
        keep(state, pd.concat([jobs, newest], ignore_index=True).groupby("job_id", as_index=False).max(), firsts)
        if len(found):
            yield pd.DataFrame({"job_id": found.job_id if key[0] >= 0 else None, "seq": found.seq, "stage": found.stage,
                                "paused": ~(found.since < found.seq)})

    return run


def pause_stream(steps: DataFrame, order: list[str], keep_s: int | None = None) -> DataFrame:
    """Whether each announced pause takes effect: not for a stage already answered.

    With ``keep_s``, ``steps`` has ``event_time`` with a watermark, and a job's state goes once the
    watermark is ``keep_s`` past its newest row.
    """
    steps.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    group = F.when(F.col("job_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(JOB_GROUPS))).cast("int")
    return steps.withColumn("job_group", group).groupBy("job_group").applyInPandasWithState(
        _pauses(order, keep_s), PAUSES, PAUSE_STATE, "append",
        GroupStateTimeout.NoTimeout if keep_s is None else GroupStateTimeout.EventTimeTimeout)
