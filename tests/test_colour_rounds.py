"""Colour groups: images inside tasks and images spread over tasks."""

import random

import pytest
from conftest import pixels
from rasterqa.operators import colour

rnd = random.Random(18)


def picture(w, h, shades):
    some = [tuple(rnd.randrange(256) for _ in range(3)) for _ in range(shades)]
    return [[(*rnd.choice(some), rnd.choice([0, 20, 21, 255, 255])) for _ in range(w)] for _ in range(h)]


@pytest.fixture(scope="module")
def art(spark):
    images = {i: picture(8, 8, 64) for i in range(40)}
    images |= {100: picture(4, 1, 1), 101: picture(6, 6, 3), 102: picture(6, 6, 5), 103: picture(30, 30, 700), 104: [[(9, 9, 9, 0)]]}
    images[105] = [[(v, v, v, 255) for v in (0, 100, 200, 50, 150, 250)] * 2]  # ties
    return pixels(spark, images).cache()


def test_both_ways_agree(spark, art, monkeypatch):
    monkeypatch.setattr(colour, "TASK_ROWS", 100)
    near, far = (sorted(map(tuple, colour.colour_groups(art, whole=w).collect())) for w in (4096, 0))
    assert near == far and len({r[0] for r in near}) == 45
    assert sorted(map(tuple, colour.colour_groups(art, whole=60).collect())) == far


def test_small_images_take_no_rounds(art, monkeypatch):
    monkeypatch.setattr(colour, "spread_groups", None)
    assert colour.colour_groups(art).count() > 40
