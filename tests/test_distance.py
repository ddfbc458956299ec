"""Linear distances and stroke thickness against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterqa.operators import envelopes, kernels

SCHEMA = "image_id long, w int, h int, x int, y int, hit boolean"


def plain(shape, pts):
    yy, xx = np.mgrid[:shape[0], :shape[1]]
    return np.sqrt(np.min([(yy - y) ** 2 + (xx - x) ** 2 for y, x in pts], axis=0)) if pts else None


def test_envelope_of_random_columns():
    rnd = np.random.default_rng(4)
    for h, n in ((1, 3), (7, 40), (40, 25)):
        f = np.where(rnd.random((h, n)) < 0.4, np.inf, rnd.integers(0, 60, (h, n)) ** 2).astype(float)
        y = np.sort(rnd.choice(200, h, replace=False))[:, None] * np.ones((1, n))
        want = np.min((y[:, None] - y[None]) ** 2 + f[None], axis=1)
        assert np.array_equal(envelopes.nearest_squares(f, y), want)


def test_thickness_is_the_largest_covering_disc():
    rnd = np.random.default_rng(9)
    for _ in range(6):
        on = np.zeros((40, 50), bool)
        for _ in range(5):
            y, x, h, w = rnd.integers(0, 30), rnd.integers(0, 35), rnd.integers(1, 12), rnd.integers(1, 16)
            on[y:y + h, x:x + w] = True
        d = np.where(on, plain(on.shape, list(zip(*np.nonzero(~on)))), 0.0)
        wide = np.pad(d, 1)
        peak = np.max([wide[i:i + 40, j:j + 50] for i in range(3) for j in range(3)], axis=0)
        ridge = on & (d >= peak)
        want = np.zeros(ridge.sum())
        for r in envelopes.radius_levels(d.max(), 2048):
            near = plain(on.shape, list(zip(*np.nonzero(d >= r - 1e-3))))[ridge] <= r + 0.5
            want[near] = np.maximum(want[near], r)
        assert np.array_equal(envelopes.ridge_thickness(d, 2048), want)


@pytest.mark.parametrize("cells", [1 << 18, 20])
def test_distances_of_many_images(spark, monkeypatch, cells):
    rnd, data, want = random.Random(3), [], {}
    for image, (h, w, share) in enumerate([(11, 15, 0.05), (1, 9, 0.3), (30, 2, 0.1), (8, 8, 0.0), (6, 6, 1.0)]):
        pts = [(y, x) for y in range(h) for x in range(w) if rnd.random() < share]
        data += [(image, w, h, x, y, (y, x) in pts) for x in range(w) for y in range(h)]
        want[image] = plain((h, w), pts)
    px = spark.createDataFrame(data, SCHEMA).withColumn("more", F.lit("kept"))
    monkeypatch.setattr(envelopes, "CELLS", cells)
    for bound in (None, 0, 3):
        rows = kernels.distance_to(px, {"d": "hit", "e": "hit"}, bound=bound).collect()
        assert len(rows) == len(data)
        for r in rows:
            d = None if want[r.image_id] is None else want[r.image_id][r.y, r.x]
            d = None if d is None or (bound is not None and d > bound) else d
            assert r.d == d and r.e == d and r.more == "kept"
    assert kernels.distance_to(px, {"d": "hit"}, only="hit").count() == sum(r[5] for r in data)


def test_cut_batches_give_the_same():
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    rows = sorted((k, x, y) for k in range(3) for x in range(4) for y in range(9))
    t = pa.table({"k": [r[0] for r in rows], "x": [r[1] for r in rows], "y": [r[2] for r in rows],
                  "_d": pa.array([None if rnd.random() < 0.5 else int(rnd.integers(0, 5)) for _ in rows], pa.int32())})
    kept, envelopes.CELLS = envelopes.CELLS, 30
    try:
        got = [pa.Table.from_batches(envelopes.column_pass(["k", "x"], {"d": "_d"})(iter(t.to_batches(max_chunksize=n)))).column("d").to_pylist() for n in (7, 50, 1000)]
    finally:
        envelopes.CELLS = kept
    assert got[0] == got[1] == got[2]


def test_a_large_solid_square_is_linear():
    took = []
    for side in (256, 1024):
        f = np.full((side, 64), np.inf)
        f[0] = f[-1] = 0
        f[1:-1] = (side // 2) ** 2
        t0 = time.time()
        envelopes.nearest_squares(f, np.arange(side)[:, None] * np.ones((1, 64)))
        took.append(time.time() - t0)
    assert took[1] < 16 * max(took[0], 0.01)
