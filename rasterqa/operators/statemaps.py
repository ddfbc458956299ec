"""State machines over a key's events, cut into time slots that run side by side.

A slot is a function from the state it starts in to the state it ends in. The functions of
all slots are worked out at once, a thin pass over their borders composes them in time order and so
gives every slot its true start, and all slots are replayed from there at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterqa.operators.ordered import ordered_fold

UNIT = ["key", "_slot"]
#: Rows that are gathered before whole slots are worked out.
ROWS = 1 << 16


class Attempts:
    """One slot of attempts in time order, seen as hops between events at which no failure is pending.

    From such an event the next one follows a success, or is the first one after a lock has run out, so
    all hops come from sorted searches and whole paths from doubling them.
    """

    def __init__(self, ts: np.ndarray, ok: np.ndarray, failures: int, seconds: float):
        self.ts, self.ok, self.failures, self.seconds = ts, ok, failures, seconds
        self.n = len(ts)
        self.before = np.concatenate(([0], np.cumsum(~ok)))
        self.failed = np.append(np.flatnonzero(~ok), [self.n] * failures)
        self.succeeded = np.append(np.flatnonzero(ok), self.n)
        self.passed = np.concatenate(([0], np.cumsum(ok)))
        self.next, self.lock = self.hop(np.arange(self.n), np.zeros(self.n, np.int64))

    def hop(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From event ``at`` with ``count`` failures pending: the next event without any (``n``: none in
        the slot), and the failure that locks (``n``: none)."""
        fatal = self.failed[np.minimum(self.before[at] + self.failures - 1 - count, len(self.failed) - 1)]
        cleared = self.succeeded[self.passed[at]]
        locks = fatal < cleared
        free = np.searchsorted(self.ts, np.append(self.ts, np.inf)[fatal] + self.seconds)
        return np.where(locks, free, np.minimum(cleared + 1, self.n)), np.where(locks, fatal, self.n)

    def ends(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Failures pending and the end of a lock (0: none) after the slot."""
        hop, lock = self.hop(at, count)
        last = np.where(self.next < self.n, self.next, np.arange(self.n))
        while True:  # the last stop of each path, twice as far each time
            far = last[last]
            if np.array_equal(far, last):
                break
            last = far
        on = hop < self.n
        stop = np.where(on, last[np.minimum(hop, self.n - 1)], at)
        pending = np.where(on, 0, count)
        lock = np.where(on, self.lock[stop], lock)
        trailing = pending + self.before[self.n] - self.before[stop]
        whole = self.passed[self.n] > self.passed[stop]  # a success is the last event
        until = np.where(lock < self.n, np.append(self.ts, 0)[lock] + self.seconds, 0)
        return np.where((lock < self.n) | whole, 0, trailing), until

    def outcomes(self, count: int, until: float) -> np.ndarray:
        """What becomes of each attempt from the given start."""
        out = np.full(self.n, "refused", object)
        first = int(np.searchsorted(self.ts, until)) if until else 0
        if first >= self.n:
            return out
        pending = 0 if until else count
        hop, lock = self.hop(np.array([first]), np.array([pending]))
        stop = np.zeros(self.n + 1, bool)
        stop[hop[0]] = True
        jump = np.append(self.next, self.n)
        while True:  # stops on the path: those reached so far and what lies twice as far ahead
            more = stop.copy()
            more[jump[np.flatnonzero(stop)]] = True
            if np.array_equal(more, stop):
                break
            stop, jump = more, jump[jump]
        stop[first] = True
        at = np.maximum.accumulate(np.where(stop[:-1], np.arange(self.n), -1))
        seen = at >= 0
        locks = np.append(self.lock, self.n)
        locks[first] = lock[0]
        live = seen & (np.arange(self.n) <= locks[np.maximum(at, 0)])
        out[live] = np.where(self.ok[live], "success", np.where(np.arange(self.n)[live] == locks[at[live]], "locked", "failure"))
        return out


def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole slots; rows come sorted by key and slot."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= ROWS:
            pdf = pd.concat(held, ignore_index=True)
            last = pdf.iloc[-1]
            open_ = ((pdf["key"] == last["key"]) & (pdf["_slot"] == last["_slot"])).to_numpy()
            if not open_.all():
                yield pdf[~open_]
            held, rows = [pdf[open_]], int(open_.sum())
    if rows:
        yield pd.concat(held, ignore_index=True)


def each_slot(pdf: pd.DataFrame) -> Iterator[tuple[int, int]]:
    key, slot = pdf["key"].to_numpy(), pdf["_slot"].to_numpy()
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])])
    yield from zip(new, np.r_[new[1:], len(pdf)])


def slot_functions(failures: int, seconds: float, length: int) -> Callable:
    """For each slot the start states that can be met: the first event with any count, and the
    events with none that a lock of the slot before may run out at."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in units(batches):
            parts = []
            for lo, hi in each_slot(pdf):
                ts = pdf["ts"].to_numpy()[lo:hi]
                slot = Attempts(ts, pdf["ok"].to_numpy()[lo:hi].astype(bool), failures, seconds)
                late = np.searchsorted(ts, pdf["_slot"].iloc[lo] * length + seconds)
                at = np.r_[np.zeros(failures, np.int64), np.arange(1, min(late + 1, hi - lo))]
                count = np.r_[np.arange(failures), np.zeros(len(at) - failures, np.int64)]
                end, until = slot.ends(at, count)
                parts.append(pd.DataFrame({"key": pdf["key"].iloc[lo], "_slot": pdf["_slot"].iloc[lo], "at": at,
                                           "ts": ts[at].astype(float), "count": count, "end_count": end, "end_until": until.astype(float)}))
            yield pd.concat(parts)
    return run


def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which each slot of a key begins; rows are the slots' functions in time order."""
    key = slot = None
    count, until, done = 0, 0.0, False
    for pdf in batches:
        out = []
        for k, s, ts, c, end, end_until in pdf[["key", "_slot", "ts", "count", "end_count", "end_until"]].itertuples(index=False, name=None):
            if k != key:
                key, slot, count, until = k, None, 0, 0.0
            if s != slot:
                slot, done = s, False
                if until and ts >= until:
                    count, until = 0, 0.0
                out.append((k, s, count, until))
            if not done and (c == 0 and ts >= until if until else c == count):
                count, until, done = end, end_until, True
        yield pd.DataFrame(out, columns=["key", "_slot", "count", "until"])


def replay(failures: int, seconds: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in units(batches):
            out = np.empty(len(pdf), object)
            for lo, hi in each_slot(pdf):  # the first row holds the start
                slot = Attempts(pdf["ts"].to_numpy()[lo + 1:hi], pdf["ok"].to_numpy()[lo + 1:hi].astype(bool), failures, seconds)
                out[lo + 1:hi] = slot.outcomes(int(pdf["count"].iloc[lo]), float(pdf["until"].iloc[lo]))
            on = pdf["_event"].to_numpy().astype(bool)
            yield pd.DataFrame({"key": pdf["key"][on], "attempt_id": pdf["attempt_id"][on], "outcome": out[on]})
    return run


def whole_keys(failures: int, seconds: float) -> Callable:
    """Keys that are one slot each: no start state but the empty one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in units(batches):
            ts, ok = pdf["ts"].to_numpy(), pdf["ok"].to_numpy().astype(bool)
            out = np.where(ok, "success", "failure").astype(object)
            keys = np.array(list(each_slot(pdf)))
            many = np.add.reduceat((~ok).astype(np.int64), keys[:, 0]) >= failures  # no other key is ever locked
            for lo, hi in keys[many].tolist():
                out[lo:hi] = Attempts(ts[lo:hi], ok[lo:hi], failures, seconds).outcomes(0, 0.0)
            yield pd.DataFrame({"key": pdf["key"], "attempt_id": pdf["attempt_id"], "outcome": out})
    return run


def lockout_outcomes(attempts: DataFrame, failures: int, seconds: float, length: int, whole: int = ROWS) -> DataFrame:
    """Outcomes of ``(key, ts, attempt_id, ok)``. A key of more than ``whole`` attempts is cut into slots of
    ``length`` seconds, ``seconds`` at least; any other is one slot, whose start is known."""
    if length < seconds:
        raise ValueError("a slot must not be shorter than a lock")
    busy = F.broadcast(attempts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > whole).select("key"))
    rest = attempts.join(busy, "key", "left_anti").select("key", F.lit(0).alias("_slot"), "ts", "attempt_id", "ok")
    schema = T.StructType([attempts.schema["key"], attempts.schema["attempt_id"], T.StructField("outcome", T.StringType())])
    done = ordered_fold(rest, ["key"], ["ts", "attempt_id"], whole_keys(failures, seconds), schema)
    return done.unionByName(slot_outcomes(attempts.join(busy, "key", "left_semi"), failures, seconds, length, schema))


def slot_outcomes(attempts: DataFrame, failures: int, seconds: float, length: int, schema: T.StructType) -> DataFrame:
    """Outcomes of the attempts of busy keys, slot by slot."""
    cut = attempts.select("key", F.floor(F.col("ts") / length).cast("bigint").alias("_slot"), "ts", "attempt_id", "ok")
    order = ["ts", "attempt_id"]
    key = cut.schema["key"].dataType.simpleString()
    maps = ordered_fold(cut, UNIT, order, slot_functions(failures, seconds, length),
                        f"key {key}, _slot bigint, at bigint, ts double, count bigint, end_count bigint, end_until double")
    starts = ordered_fold(maps, ["key"], ["_slot", "at", "count"], compose, f"key {key}, _slot bigint, count bigint, until double")
    # starts go along as rows of their slots, so the events are shuffled once
    first = starts.select("key", "_slot", *[F.lit(0).cast(cut.schema[c].dataType).alias(c) for c in order], F.lit(False).alias("ok"),
                          "count", "until", F.lit(False).alias("_event"))
    rows = cut.select("*", F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("until"), F.lit(True).alias("_event"))
    return ordered_fold(rows.unionByName(first), UNIT, ["_event", *order], replay(failures, seconds), schema)


def accepted_calls(ts: np.ndarray, kept: np.ndarray, n: int, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Which calls of one burst are accepted after those at ``kept``, and the last ``n`` accepted times.

    The number of accepted calls up to call i is the smaller of one more than before and ``n`` more than were
    accepted before its window opens. Within the length of one window the second term hangs on
    earlier lengths only, so the first unrolls to a running minimum.
    """
    accepted = np.zeros(len(ts), bool)
    at = 0
    while at < len(ts):
        end = int(np.searchsorted(ts, ts[at] + window, side="right"))
        part = ts[at:end]
        rank = np.arange(1, len(part) + 1)
        room = np.searchsorted(kept, part - window, side="left") + n
        total = rank + np.minimum(len(kept), np.minimum.accumulate(room - rank))
        accepted[at:end] = np.diff(total, prepend=len(kept)) == 1
        kept = np.concatenate([kept, part[accepted[at:end]]])[-n:]
        at = end
    return accepted, kept


def accept_within(n: int, window: float) -> Callable:
    """At most ``n`` accepted calls in any window; rows come sorted by key, burst and time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, kept = None, np.zeros(0)
        for pdf in batches:
            ts, key, burst = (pdf[c].to_numpy() for c in ("ts", "key", "burst"))
            if not len(pdf):
                continue
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (burst[1:] != burst[:-1])])
            end = np.r_[new[1:], len(pdf)]
            accepted = np.ones(len(pdf), bool)  # a burst of n calls or fewer is accepted whole
            large = np.flatnonzero(end - new > n)
            for k in sorted({0, len(new) - 1, *large.tolist()}):
                lo, hi = new[k], end[k]
                if (key[lo], burst[lo]) != unit:
                    unit, kept = (key[lo], burst[lo]), ts[:0]
                accepted[lo:hi], kept = accepted_calls(ts[lo:hi], kept, n, window)
            yield pd.DataFrame({"key": key, "call_id": pdf["call_id"], "accepted": accepted})
    return run
