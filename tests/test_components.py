"""Strip labels against a plain search, and regions inside holes."""

import numpy as np
from pyspark.sql import functions as F

from rasterqa.operators import components as cc
from rasterqa.operators import metrics


def flood(mask, steps):
    """Component number of each set cell by plain search."""
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        label[y, x] = n
        while todo:
            cy, cx = todo.pop()
            for dy, dx in steps:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not label[ny, nx]:
                    label[ny, nx] = n
                    todo.append((ny, nx))
    return label


FOUR = [(0, 1), (0, -1), (1, 0), (-1, 0)]
EIGHT = FOUR + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def relation(spark, images):
    rows = [(i, m.shape[1], m.shape[0], x, y, bool(m[y, x])) for i, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "image_id long, w int, h int, x int, y int, content boolean")


def test_components_of_noise_across_strips(spark):
    rng = np.random.default_rng(5)
    images = {i: rng.random((600, 12)) < share for i, share in enumerate((0.3, 0.5, 0.62, 1.1))}
    images[9] = np.zeros((600, 12), bool)
    images[9][:, ::2] = True  # a comb: one long component
    images[9][599] = True
    px = relation(spark, images).filter("content").select("image_id", "x", "y")
    for connectivity, steps in ((4, FOUR), (8, EIGHT)):
        got = {}
        for r in cc.components(px, connectivity).collect():
            got.setdefault(r.image_id, []).append(r.area)
        for i, mask in images.items():
            label = flood(mask, steps)
            assert sorted(got[i]) == sorted(np.bincount(label[label > 0])[1:].tolist()), (i, connectivity)


def test_nesting_against_flooding_from_outside(spark):
    rng = np.random.default_rng(6)
    images = {i: rng.random((24, 30)) < 0.35 + i / 40 for i in range(8)}
    ring = np.zeros((20, 20), bool)
    ring[2:18, 2:18] = True
    ring[4:16, 4:16] = False
    ring[7:13, 7:13] = True
    ring[9:11, 9:11] = False
    images[20] = ring
    wide = np.zeros((9, 200), bool)
    wide[1:8, 1:199] = True
    wide[2:7, 2:198] = False
    wide[4, 150] = True
    images[21] = wide
    got = {(r.image_id, r.comp_id): r.hole is not None for r in cc.nesting(relation(spark, images)).collect()}
    for i, mask in images.items():
        label = flood(mask, EIGHT)
        sky = flood(np.pad(~mask, 1, constant_values=True), FOUR)
        outside = sky == sky[0, 0]
        for n in range(1, label.max() + 1):
            ys, xs = np.nonzero(label == n)
            first = (int(ys.min()) << 20) + int(xs[ys == ys.min()].min())
            outer = any(outside[y + 1 + dy, x + 1 + dx] for y, x in zip(ys, xs) for dy, dx in FOUR)
            assert got.pop((i, first)) == (not outer), (i, n)
    assert not got
    feats = {r.image_id: r.n_contours for r in metrics.contour_features(cc.nesting(relation(spark, {20: ring, 21: wide}))).collect()}
    assert feats == {20: 1, 21: 1}


def test_nesting_of_nothing(spark):
    blank = relation(spark, {1: np.zeros((3, 3), bool)})
    assert cc.nesting(blank).count() == 0 and cc.nesting(blank.filter(F.lit(False))).count() == 0


def test_strips_stay_whole_with_a_constant_key(spark):
    cells = spark.range(600 * 64).filter(F.xxhash64("id") % 2 == 0)
    mask = np.zeros(600 * 64, bool)
    mask[[r.id for r in cells.collect()]] = True
    label = flood(mask.reshape(600, 64), EIGHT)
    px = cells.selectExpr("1L as image_id", "int(id % 64) as x", "int(id div 64) as y")
    assert sorted(r.area for r in cc.components(px, 8).collect()) == sorted(np.bincount(label[label > 0])[1:].tolist())
