"""Hashes against brute force over the cells, and no row per cell of the enlarged raster."""

import math

import numpy as np
from pyspark.sql import functions as F

from rasterqa.operators import compare, dct


def brute(level, size, low):
    """64-bit words of an array with NaN where there is no pixel."""
    h, w = level.shape
    cells = np.zeros((size, size))
    share = lambda cell, n: [(p, min((p + 1) * size, (cell + 1) * n) - max(p * size, cell * n)) for p in range(n)]
    for ty in range(size):
        for tx in range(size):
            hits = [(level[y, x], a * b) for y, a in share(ty, h) if a > 0 for x, b in share(tx, w) if b > 0 and not math.isnan(level[y, x])]
            if hits:
                cells[ty, tx] = round(round(sum(v * n for v, n in hits) / sum(n for _, n in hits), 6))
    wave = np.array([[math.cos((2 * p + 1) * math.pi * k / (2 * size)) for p in range(size)] for k in range(low)])
    coef = np.round((wave @ cells @ wave.T).ravel(), 6)
    return "".join("01"[int(c > round(float(np.median(coef)), 6))] for c in coef)


def test_hash_of_small_wide_tall_and_gappy_rasters(spark):
    rng = np.random.default_rng(7)
    art = {1: rng.integers(0, 256, (8, 8)).astype(float), 2: rng.integers(0, 256, (5, 150)).astype(float),
           3: rng.integers(0, 256, (130, 9)).astype(float), 4: rng.integers(0, 256, (90, 70)).astype(float)}
    art[5] = np.where(rng.random((12, 100)) < 0.4, np.nan, rng.integers(0, 256, (12, 100)))
    rows = [(i, a.shape[1], a.shape[0], x, y, float(a[y, x])) for i, a in art.items()
            for y in range(a.shape[0]) for x in range(a.shape[1]) if not math.isnan(a[y, x])]
    grey = spark.createDataFrame(rows, "image_id long, w int, h int, x int, y int, grey double").repartition(7)
    out = {r.image_id: r for r in compare.phash256(grey).collect()}
    for i, a in art.items():
        assert out[i].hash_bits == brute(a, 64, 16), i
        assert "".join(f"{w & (2 ** 64 - 1):064b}" for w in out[i].words) == out[i].hash_bits


def test_no_row_per_cell(spark):
    grey = spark.range(4).selectExpr("id as image_id", "explode(sequence(0, 63)) as i").selectExpr(
        "image_id", "8 as w", "8 as h", "cast(i % 8 as int) as x", "cast(i div 8 as int) as y", "cast(i * 3 as double) as grey").localCheckpoint()
    assert "Generate" not in compare.phash256(grey)._jdf.queryExecution().toString()
    assert dct.hashes(grey, "grey", 32, 8, True, ("image_id",)).select(F.length("hash_bits")).distinct().collect() == [(64,)]
