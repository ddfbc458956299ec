"""Periodic runs against every shift on its own."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from llm import brute
from llm.test_llm import ODD, docs, odd, pairs, sort, texts  # noqa: F401  (fixtures)
from rasterqa.llm import runs, words
from rasterqa.llm.queries import with_planted_repeats

PART = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7)).map(lambda t: t[0] * t[1])
TEXT = st.lists(PART, max_size=6).map(lambda parts: sum(parts, []))


def found(texts, **kw):
    flat = words.mix(np.array(sum(texts, []), np.uint64))
    return runs.runs_of(flat, np.array([len(t) for t in texts], np.int64), **kw).T.tolist()


def plain(texts, **kw):
    out, base = [], 0
    for t in texts:
        out += [[s + base, e + base, q] for s, e, q in brute.periodic(t, **kw)]
        base += len(t)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_runs_of_a_chunk(texts):
    assert found(texts + texts[:1]) == plain(texts + texts[:1])
    assert found(texts, exponent=5, least=9) == plain(texts, exponent=5, least=9)


@pytest.mark.parametrize("text, want", [
    ([0] * 100_000, [[0, 100_000, 1]]),
    ([0, 1] * 40_000 + [7], [[0, 80_000, 2]]),
    (list(range(100_000)), []),
    ([bin(i).count("1") % 2 for i in range(1 << 14)], []),  # overlap-free, and hard for hash sums
])
def test_long_texts(text, want):
    assert found([text]) == want


def test_a_rule_is_used_for_all_its_places():
    h = words.mix(np.array([1, 2, 3, 4] * 2 + [9] + [1, 2, 3, 4], np.uint64))
    ids = np.unique(h, return_inverse=True)[1]
    g = runs.re_pair(ids, np.array([8, 5]), 5)
    assert len(g.left) < 8 and len(set(zip(g.left.tolist(), g.right.tolist()))) == len(g.left)


def test_false_agreement_is_mended(monkeypatch):
    monkeypatch.setattr(runs.Stretches, "equal", lambda self, a, b, length: np.ones(len(a), bool))
    text = [5, 6] * 6 + [1] * 7 + [2, 3, 4] * 5
    assert set(map(tuple, found([text]))) <= set(map(tuple, plain([text])))


def test_query_and_odd_rows(spark, odd, texts):  # noqa: F811
    got = entry.queries()["op13_periodic_runs"](spark, SF).collect()
    assert sort(map(tuple, got)) == sort(brute.run_row(i, t) for i, t in texts)
    rows = runs.periodic_runs(with_planted_repeats(odd)).collect()
    want = {i: [(s, e - s, q) for s, e, q in brute.periodic(brute.planted(i, t))] for i, t in pairs() if i != 11}
    assert len(rows) == len(ODD) and all([tuple(x) for x in r.runs] == want[r.doc_id] for r in rows if r.doc_id != 11)
    none = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sort(map(tuple, runs.periodic_runs(none).select("doc_id", "n_words").collect())) == sort([(None, 2), (None, 0)])
    assert runs.periodic_runs(odd.filter(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, exponent=3)
