"""Lock-outs by composed slot functions against one walk over each key."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterqa.operators import events, statemaps


def walk(rows, failures=5, seconds=300):
    out, state = {}, {}
    for key, ts, i, ok in sorted(rows):
        count, until = state.get(key, (0, 0))
        if until and ts >= until:
            count, until = 0, 0
        if until:
            out[i] = "refused"
        elif ok:
            count, out[i] = 0, "success"
        else:
            count += 1
            if count >= failures:
                until = ts + seconds
            out[i] = "locked" if until else "failure"
        state[key] = count, until
    return out


EVENTS = st.lists(st.tuples(st.integers(0, 40), st.booleans()), min_size=1, max_size=60).map(sorted)


@settings(max_examples=400, deadline=None)
@given(EVENTS, st.integers(0, 2), st.integers(1, 12))
def test_one_slot(rows, count, seconds):
    ts, ok = np.array([r[0] for r in rows]) + 100, np.array([r[1] for r in rows])
    slot = statemaps.Attempts(ts, ok, 3, seconds)
    before = [(1, -10 * seconds + k, -1 - k, False) for k in range(count)]
    want = walk(before + [(1, int(t), i, bool(o)) for i, (t, o) in enumerate(zip(ts, ok))], 3, seconds)
    assert slot.outcomes(count, 0.0).tolist() == [want[i] for i in range(len(rows))]
    end, until = slot.ends(np.array([0]), np.array([count]))
    tail = [(1, int(ts[-1]), 10_000 + k, False) for k in range(3)]  # probes of the end state
    more = walk(before + [(1, int(t), i, bool(o)) for i, (t, o) in enumerate(zip(ts, ok))] + tail, 3, seconds)
    probe = [more[10_000 + k] for k in range(3)]
    if until[0] > ts[-1]:
        assert probe == ["refused"] * 3
    else:
        left = 0 if until[0] else int(end[0])
        assert probe.index("locked") == 3 - left - 1


@pytest.mark.parametrize("seconds, slot", [(300, 300), (300, 1000), (50, 5000)])
def test_keys_and_slots(spark, seconds, slot):
    rnd, rows = random.Random(seconds + slot), []
    for i in range(6000):
        key = "hot" if rnd.random() < 0.6 else rnd.choice("abcd")
        rows.append((key, rnd.randint(0, 40_000) * rnd.choice([1.0, 1.0, 0.5]), i, rnd.random() < 0.25))
    rows += [("ties", 600.0, 10_000 + i, i % 7 == 6) for i in range(40)] + [("one", 5.0, 20_000, False)]
    d = spark.createDataFrame(rows, "key string, ts double, attempt_id long, ok boolean")
    got = {r.attempt_id: r.outcome for r in events.lockouts(d, seconds=seconds, slot=slot).collect()}
    assert got == walk(rows, seconds=seconds)


def test_a_hot_key_spreads_over_its_slots(spark):
    d = spark.range(200_000).selectExpr("1L key", "id * 20 ts", "id attempt_id", "id % 9 = 0 ok")
    assert events.lockouts(d).groupBy("outcome").count().count() >= 3
    plan = events.lockouts(d)._jdf.queryExecution().toString()
    assert "key" in plan and plan.count("_slot") > 4


def test_wrong_slot_and_empty(spark):
    none = spark.createDataFrame([], "key long, ts long, attempt_id long, ok boolean")
    assert events.lockouts(none).count() == 0
    with pytest.raises(ValueError):
        events.lockouts(none, seconds=300, slot=10)


def limit(times, n, window):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if t - k <= window]
        out.append(len(kept) < n)
        if out[-1]:
            kept.append(t)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=80).map(sorted), st.integers(1, 6), st.integers(0, 15), st.integers(0, 80))
def test_accepted_calls(times, n, window, cut):
    ts = np.array(times)
    first, kept = statemaps.accepted_calls(ts[:cut], ts[:0], n, window)
    second, kept = statemaps.accepted_calls(ts[cut:], kept, n, window)
    assert [*first, *second] == limit(times, n, window) and len(kept) <= n


def test_limiter_over_keys(spark):
    rnd, rows = random.Random(8), []
    for i in range(4000):
        rows.append((rnd.choice([1, 1, 1, 2, 3]), i, rnd.randint(0, 9000)))
    rows += [(4, 5000 + i, 100 + i // 500) for i in range(30_000)]  # a burst over many batches
    d = spark.createDataFrame(rows, "key long, call_id long, ts long")
    got = {r.call_id: r.accepted for r in events.rate_limit(d, n=6, window=20, slot=500).collect()}
    for key in (1, 2, 3, 4):
        mine = sorted((t, i) for k, i, t in rows if k == key)
        assert [got[i] for _, i in mine] == limit([t for t, _ in mine], 6, 20)
