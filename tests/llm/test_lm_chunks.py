"""Texts are scored in one round, however large the filter; chunks change no result."""

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from rasterqa.llm import lm


def test_one_round_whatever_the_size_of_the_filter(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.train(docs)
    whole = lm.sent_parts(model, model.groups[0]).value
    model.groups = [[p] for g in model.groups for p in g]  # as if one part alone were all that can be sent
    calls, keep = [], lm.saved
    monkeypatch.setattr(lm, "saved", lambda df, **options: calls.append(1) or keep(df, **options))
    got = {r.id: r.score for r in lm.score(docs, model).collect()}
    assert len(model.groups) > 2 and len(calls) == 1
    for r in docs.limit(20).collect():
        tokens, counts = lm.token_hashes([(r.text or "").encode().lower()])
        levels = lm.levels_at(whole, tokens, counts, whole.exact(tokens), None, 3, 1, model.texts, np.ones(model.parts, bool))
        want = np.log10(lm.interpolated(levels, counts, 1, model.tokens, model.vocabulary, model.texts)).sum()
        assert abs(got[r.doc_id] - want) < 1e-6


def test_chunks_change_no_result(spark, monkeypatch):
    texts = [None, "", " ", "the same text again and again", "the same text again and again", "İ x퟿ y\n" * 30, "a b c " * 400]
    rows = [(i, f"word{i % 7} and word{i % 3} then {i}") for i in range(200)] + [(None, t) for t in texts] + [(7, t) for t in texts] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10

    def results():
        return sorted(((*(tuple(r)[:4]), round(r.base_score, 6), round(r.score, 6)) for r in lm.score_held_out(docs, fold).collect()), key=str)

    one = results()
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 100)
    assert results() == one and len(one) == len(rows)
    model = lm.train(docs.filter(fold != 0))
    two = lm.score(docs, model).collect()
    assert sorted((str(r.id), r.n_known, round(r.score, 6)) for r in two) == sorted((str(r[0]), r[2], r[5]) for r in one)


def test_squeezed_hashes_come_back():
    for n in (0, 1, 3, 5_000):
        key, count = lm.distinct(lm.words.mix(np.arange(n, dtype=np.uint64) // np.uint64(2)))
        assert (lm.hashes_from(lm.squeezed(key), len(key)) == key).all() and count.sum() == n
        raw = lm.packed_numbers(count.astype("<u4"))
        assert (lm.numbers_from(raw, len(key), "<u4") == count).all()
    spread = np.sort(lm.words.mix(np.arange(5_000, dtype=np.uint64))) >> np.uint64(8)
    assert len(lm.squeezed(spread)) < 6.2 * 5_000
