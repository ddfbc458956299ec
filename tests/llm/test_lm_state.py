"""What lies on disk between two passes of the language model."""

import os
from urllib.parse import urlparse

import numpy as np
from conftest import SF
from rasterqa.llm import lm


def test_texts_and_levels_between_passes_are_packed(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.train(docs)
    half = len(model.groups[0]) // 2
    model.groups = [model.groups[0][:half], model.groups[0][half:]]
    sizes, keep = [], lm.saved

    def measured(df, **options):
        for state in (keep(df), keep(df, **options)):  # as Spark writes by default, and as the operator asks for
            sizes.append(sum(os.path.getsize(urlparse(f).path) for f in state.inputFiles()))
        return state

    monkeypatch.setattr(lm, "saved", measured)
    assert lm.score(docs, model).count() == docs.count()
    assert len(sizes) == 2 and sizes[1] < 0.75 * sizes[0]


def test_parts_are_ranges_of_hashes():
    key = np.sort(lm.words.mix(np.arange(50_000, dtype=np.uint64)))
    part = lm.part_of(key, 64)
    assert (np.diff(part) >= 0).all() and np.bincount(part, minlength=64).min() > 600
