"""What a task of the corpus pipeline holds: batches by bytes, and sums of shingles in little more than one copy."""

import tracemalloc
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from rasterqa.llm import neardup
from rasterqa.llm.common import BATCH_BYTES
from pyspark.sql import functions as F


def common(texts, least, step):
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t)], names=["id", "text"]) for t in (texts[i:i + step] for i in range(0, len(texts), step))]
    out = list(neardup.gather_common(3, least)(iter(batches)))[0]
    return dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))


@pytest.mark.parametrize("gather", [1, 40, 10**9])
def test_sums_of_shingles(monkeypatch, gather):
    monkeypatch.setattr(neardup, "GATHER", gather)
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 4, rng.integers(0, 30)))) for _ in range(60)]
    sets = [s for _, s in neardup.shingle_sets([t.encode() for t in texts], 3)]
    want, held, weight = Counter(), Counter(), 0
    for s in sets:
        held.update(s.view(np.int64).tolist())
        weight += len(s)
        if weight > gather:
            want = Counter({v: n for v, n in (want + held).items() if n > 1})
            held, weight = Counter(), 0
    for least in (1, 2, 4):
        assert common(texts, least, 7) == {v: n for v, n in (want + held).items() if n >= least}
    assert common([], 4, 7) == {} and common([""], 1, 7) == {}


def test_a_full_store_is_summed_in_little_memory(monkeypatch):
    values = np.random.default_rng(1).integers(0, 1 << 62, 2_000_000, dtype=np.uint64)
    monkeypatch.setattr(neardup, "shingle_sets", lambda texts, size: enumerate(np.split(values.copy(), len(texts))))
    tracemalloc.start()
    common(["x"] * 1000, 4, 1000)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 70, peak  # the values are 16 MB; three copies and masks


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "packing"])
def test_batches_are_cut_by_bytes(spark, stage):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    session = spark.newSession()
    dict(corpus_pipeline.STAGES)[stage](session, session.read.parquet(f"{SF}/documents.parquet"), SF)
    long = session.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), F.lit(2000)).alias("text"))
    assert max(r.size for r in long.mapInArrow(rows, "size long").collect()) < 5_000_000


def test_a_size_of_the_session_stays(spark):
    session = spark.newSession()
    session.conf.set(BATCH_BYTES, "1m")
    corpus_pipeline.drop_near_duplicates(session, session.read.parquet(f"{SF}/documents.parquet").limit(5), SF)
    assert session.conf.get(BATCH_BYTES) == "1m"
