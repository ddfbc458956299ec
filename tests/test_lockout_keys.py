"""Lock-outs: keys that are walked whole, busy keys in slots."""

import random

import pytest

from rasterqa.operators import statemaps
from test_statemaps import walk


@pytest.mark.parametrize("whole", [0, 200, 10_000])
def test_whole_and_cut_keys_agree_with_a_walk(spark, whole):
    rnd = random.Random(whole)
    rows = [(rnd.choice(["hot", "hot", "hot", *"abcdefgh"]), rnd.randint(0, 40_000) * rnd.choice([1.0, 0.5]), i, rnd.random() < 0.25) for i in range(4000)]
    rows += [(f"rare{i % 700}", float(i), 10_000 + i, i % 3 == 0) for i in range(1400)]
    d = spark.createDataFrame(rows, "key string, ts double, attempt_id long, ok boolean")
    got = statemaps.lockout_outcomes(d, 5, 300, 1000, whole).collect()
    assert len(got) == len(rows) and {r.attempt_id: r.outcome for r in got} == walk(rows)


def test_few_attempts_are_not_worked_out_slot_by_slot(spark, monkeypatch):
    asked = []
    real = statemaps.slot_outcomes
    monkeypatch.setattr(statemaps, "slot_outcomes", lambda d, *a: asked.append(d) or real(d, *a))
    # 300 keys with one attempt a day: each day was a slot of its own, with five start states
    d = spark.range(9000).selectExpr("id % 300 key", "id * 288 ts", "id attempt_id", "id % 9 = 0 ok")
    assert statemaps.lockout_outcomes(d, 5, 86400, 86400).count() == 9000
    assert asked[0].count() == 0
