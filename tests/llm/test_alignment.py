"""Tokenizer alignment against whole-text tokens and sets of ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from llm.test_llm import ODD, docs, odd, pairs, sort, texts  # noqa: F401  (fixtures)
from rasterqa.llm import alignment
from rasterqa.llm.queries import tokenizer_pair

BITS = ["a", "b", "the", "ing", "é", "à", " ", "  ", "\n", "\t", "\r", "\xa0", " ", "　", "▁", "ﬁ", "1", "23", "'s", ".", ";",
        "<|endoftext|>", "<s>", "<0x0A>", "\U0001f600", "ß", "é", "\x00", "\x1c", "\x85", "漢字", '"', "​"]


@pytest.fixture(scope="module")
def tokens():
    return alignment.Tokens(*tokenizer_pair())


def cut(tokens, text):
    """Groups of a whole text as pairs of id lists, or None where the tokens do not spell it."""
    want = (" " + (text or "")).encode()
    if not text:
        return None
    a, b = tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
    if b"".join(tokens.a_bytes[i] for i in a) != want or b"".join(tokens.b_bytes[i] for i in b) != want:
        return None
    ends = [np.cumsum([len(names[i]) for i in ids]).tolist() for ids, names in ((a, tokens.a_bytes), (b, tokens.b_bytes))]
    groups, x, y = [], 0, 0
    at = [{e: k + 1 for k, e in enumerate(z)} for z in ends]
    for e in sorted(set(ends[0]) & set(ends[1])):
        groups.append((a[x:at[0][e]], b[y:at[1][e]]))
        x, y = at[0][e], at[1][e]
    return groups


def plain(tokens, data):
    cuts = [(i, cut(tokens, t) or []) for i, t in data]
    held = Counter(p for _, groups in cuts for p in {(a, b) for x, y in groups for a in x for b in y})
    top = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for i, groups in cuts:
        links = [(a, b) for x, y in groups for a in x for b in y]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.lists(st.integers(1, 3), max_size=60))
def test_walk_over_ends(a, b):
    x, y = (np.cumsum(v).tolist() for v in (a, b))
    end = max(x[-1:] + y[-1:], default=0) + 1
    x, y = [*x, end], [*y, end]
    ia, ib = alignment.common_ends(x, y)
    both = sorted(set(x) & set(y))
    assert [x[i] for i in ia] == both == [y[j] for j in ib]


def test_long_one_to_one_stretch():
    x = list(range(1, 100_000))
    ia, ib = alignment.common_ends(x, [v for v in x if v != 5_000])
    assert len(ia) == len(x) - 1 and (ia - ib).max() == 1


def test_segments_of_odd_texts(tokens):
    rnd = random.Random(5)
    kept = alignment.Store(tokens)
    for _ in range(3000):
        text = "".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 12)))
        raw, h, first, end, _ = alignment.segments_of([text.encode()])
        slots = kept.slots(h, raw, first, end)
        want = cut(tokens, text)
        assert all(kept.whole[s] for s in slots) == (want is not None)
        if want is not None:
            assert b";".join(kept.text[s] for s in slots).decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)


def test_query_and_odd_rows(spark, odd, texts, tokens, monkeypatch):  # noqa: F811
    got = entry.queries()["op11_align_tokenizers"](spark, SF).collect()
    assert sort(map(tuple, got)) == sort(plain(tokens, texts))
    more = pairs() + [(70, "x ▁ y"), (71, "two  spaces\n \n z "), (72, " "), (None, "a b"), (73, "<|endoftext|></s>")]
    d = spark.createDataFrame(more, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("pair", "n", "row", "links", "groups")}).repartition(3)
    want = plain(tokens, more)
    for send in (10**9, 0):  # broadcast counts, and joined ones
        rows = alignment.align_tokenizers(d, *tokenizer_pair(), send_pairs=send).withColumn("sha", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
        got = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect()
        assert sort(map(tuple, got)) == sort(want)
    none = alignment.align_tokenizers(odd.filter(F.lit(False)), *tokenizer_pair())
    assert none.count() == 0 and len(ODD) == odd.count()


def test_a_small_store_changes_nothing(tokens):
    texts = [f"word{i % 7} other {i} and more".encode() for i in range(50)]
    kept = alignment.Store(tokens)
    raw, h, first, end, counts = alignment.segments_of(texts)
    slots = kept.slots(h, raw, first, end)
    text, pair, weight = alignment.distinct_links(kept, slots, counts)
    assert weight.sum() == np.array(kept.sizes[3])[slots].sum() and len(set(zip(text.tolist(), pair.tolist()))) == len(text)
