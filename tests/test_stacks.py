"""Small images scored inside a task get what images of any size get."""

import random

from conftest import SF, pixels
from rasterqa.operators import compare, qa, stacks
from rasterqa.plans.registry import QUERIES

SIZES = [(1, 1), (1, 5), (5, 1), (2, 2), (3, 7), (8, 8), (13, 9), (20, 20), (30, 11), (9, 40), (24, 24)]


def image(rnd, w, h, kind):
    ground = (rnd.randrange(256),) * 3 + (255,)
    if kind == "noise":
        return [[tuple(rnd.randrange(256) for _ in range(3)) + (255,) for _ in range(w)] for _ in range(h)]
    rows = [[(9, 9, 9, 0) if kind == "clear" else ground] * w for _ in range(h)]
    for _ in range(rnd.randrange(1, 5) if kind in ("plain", "alpha") else 0):
        x, y = rnd.randrange(w), rnd.randrange(h)
        cw, ch = rnd.randrange(1, w - x + 1), rnd.randrange(1, h - y + 1)
        fill = tuple(rnd.randrange(256) for _ in range(3)) + (255 if kind == "plain" else rnd.choice([0, 100, 128, 129, 200, 255]),)
        for row in rows[y:y + ch]:
            row[x:x + cw] = [fill] * cw
    return rows


def test_whole_and_spread_images_score_alike(spark):
    rnd = random.Random(3)
    kinds = ["plain", "alpha", "noise", "plain", "alpha", "clear", "flat"]
    px = pixels(spark, {i: image(rnd, *SIZES[i % 11], kinds[i % 7]) for i in range(77)}).repartition(4).localCheckpoint()
    data = [(k, rnd.randrange(77), rnd.randrange(77)) for k in range(120)] + [(1000 + i, i, i) for i in range(77)]
    pairs = spark.createDataFrame(data, "pair_id long, original_id long, generated_id long").localCheckpoint()
    # 80 pixels: some pairs have both images inside a task, some one, some none
    whole, mixed = (sorted(map(tuple, compare.pair_score(pairs, px, 16, **k).drop("phash_pct", "ssim_pct").collect())) for k in ({}, {"whole": 80}))
    assert len(whole) == 197 and whole == mixed


def test_pairs_of_small_images_move_no_pixel_rows(spark):
    rnd = random.Random(4)
    px = pixels(spark, {i: image(rnd, 8, 8, "plain") for i in range(10)})
    pairs = spark.range(10).selectExpr("id as pair_id", "id as original_id", "9 - id as generated_id")
    plan = compare.pair_score(pairs, px, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_only_dense_small_images_are_packed(spark):
    px = pixels(spark, {1: [[(1, 2, 3, 255)] * 3] * 2, 2: [[(0, 0, 0, 0)] * 5] * 5, 3: [[(7, 7, 7, 7)] * 2] * 2}).filter("image_id <> 3 or x + y < 2")
    got = {r.image_id: (r.w, r.h, r.body) for r in stacks.packed(px, 24).collect()}
    assert got == {1: (3, 2, bytearray([1, 2, 3, 255] * 6)), 2: (5, 5, None), 3: (2, 2, None)}


def test_drift_moves_no_pixel_rows_to_score(spark):
    plan = QUERIES["q9_drift_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_small_images_measure_like_any(spark):
    rnd = random.Random(5)
    kinds = ["plain", "alpha", "noise", "plain", "alpha", "clear", "flat"]
    px = pixels(spark, {i: image(rnd, *SIZES[i % 11], kinds[i % 7]) for i in range(77)}).localCheckpoint()
    got = qa.qa_of_small(px, whole=200)  # 13 x 9 and less inside a task
    want = qa.qa_measurements(px).select(*got.columns)
    key = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str)
    assert sorted(map(key, qa.qa_of_small(px).collect()), key=str) == sorted(map(key, want.collect()), key=str)
