import math
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import canvas, pixels
from rasterqa.functions.numbers import half_even
from rasterqa.operators import compare, kernels, metrics


def art(seed, w=20, h=16):
    rnd = random.Random(seed)
    rows = canvas(w, h, (255, 255, 255, 0))
    for _ in range(4):
        c = (rnd.randrange(256), rnd.randrange(256), rnd.randrange(256), 255)
        bx, by = rnd.randrange(w - 6), rnd.randrange(h - 6)
        for y in range(by, by + 5):
            rows[y][bx:bx + 6] = [c] * 6
    return rows


def on_black(rows):
    return [[px if px[3] else (0, 0, 0, 0) for px in row] for row in rows]


def test_identical_pair_scores_100_and_background_does_not_matter(spark):
    one = art(1)
    px = pixels(spark, {1: one, 2: one, 3: on_black(one), 4: art(99)})
    pairs = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (12, 1, 4)], "pair_id long, original_id long, generated_id long")
    got = {r.pair_id: r for r in compare.pair_score(pairs, px, long_side=24).collect()}
    assert (got[10].overall_pct, got[10].shape_pct, got[10].edges_pct, got[10].detail_pct) == (100, 100, 100, 100)
    assert got[11].overall_pct >= 90
    assert got[12].overall_pct < got[11].overall_pct
    assert got[10].background_note == "Background: transparent in both"


def test_ssim_against_numpy(spark):
    rnd = np.random.default_rng(5)
    a, b = rnd.integers(0, 256, (9, 13)).astype(float), rnd.integers(0, 256, (9, 13)).astype(float)
    data = [(1, 13, 9, x, y, float(a[y, x]), float(b[y, x]), 1) for x in range(13) for y in range(9)]
    frames = spark.createDataFrame(data, "pair_id long, w int, h int, x int, y int, grey_o double, grey_g double, region int")
    got = compare.ssim(frames).first().ssim
    taps = np.array(kernels.gaussian_taps(11, 1.5))

    def blur(m):
        for axis in (0, 1):
            p = np.pad(m, [(5, 5) if k == axis else (0, 0) for k in (0, 1)], mode="reflect")
            m = np.apply_along_axis(lambda v: np.convolve(v, taps, "valid"), axis, p)
        return m

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    want = (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean()
    assert abs(got - max(0, want)) < 1e-9


def test_rounding_is_exact(spark):
    values = [3.675, 2.675, 4.35, 0.15, 0.25, 14.625, 1.115, 118.65625, -0.004, 1.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        got = [r[0] for r in df.select(half_even(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) + 0.0 for v in values]


def test_ratio_text(spark):
    df = spark.createDataFrame([(177, 248), (3000, 2000), (80, 294)], "w int, h int")
    rows = metrics.ratio_info(df).collect()
    assert rows[0].ratio_normalised == "177:248 (1 : 1.40)" and rows[1].ratio == "3:2"
    assert rows[2].ratio_normalised == f"80:294 (1 : {294 / 80:.2f})"
    assert rows[1].nearest_placement == min(
        [(abs(math.log(1.5 / s)), l) for s, l in __import__("rasterqa.dims", fromlist=["x"]).PLACEMENTS])[1]
