"""Boxes of grid cells against sets of cells, and no row per cell."""

import random
import re

from rasterqa.operators import replies


def cells_of(token):
    tok = token.strip().replace(" ", "").upper()
    got = re.fullmatch(r"([A-J])(\d{1,2})[-:]([A-J])(\d{1,2})", tok)
    one = re.fullmatch(r"([A-J])(\d+)", tok)
    if not got and not one:
        return set()
    a, r, b, q = got.groups() if got else one.groups() * 2
    (c0, c1), (r0, r1) = sorted("ABCDEFGHIJ".index(x) for x in (a, b)), sorted(map(int, (r, q)))
    return {(c, y - 1) for c in range(c0, c1 + 1) for y in range(r0, r1 + 1) if 1 <= y <= 10}


def test_boxes_equal_those_of_the_sets(spark):
    rng = random.Random(5)
    spot = lambda: rng.choice("ABCDEFGHIJK") + str(rng.randint(0, 12))
    objects = {i: [rng.choice([spot(), f" {spot()}-{spot()}", f"{spot()}:{spot()}".lower(), "D", "A0", "J00", "F123"]) for _ in range(rng.randint(1, 4))] for i in range(300)}
    objects[300], objects[301] = ["a1-j10"], ["J10", "A1"]
    got = replies.cells_to_bbox(spark.createDataFrame([(i, c) for i, cs in objects.items() for c in cs], "object_id long, cell string"))
    want = {}
    for i, tokens in objects.items():
        cells = set().union(*map(cells_of, tokens))
        if cells:
            (c0, c1), (r0, r1) = [(min(v), max(v)) for v in zip(*cells)]
            w, h = c1 - c0 + 1, r1 - r0 + 1
            box = (c0 / 10, r0 / 10, w / 10, h / 10) if len(cells) <= 50 and w <= 7 and h <= 7 else (None,) * 4
            want[i] = (len(cells), *box, w * h / 100 >= 0.6)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
