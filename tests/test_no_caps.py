"""Cases beyond the sizes that fixed limits once covered."""

import struct
import zlib

from pyspark.sql import functions as F

from conftest import pixels, png
from rasterqa.operators import events, kernels, metrics, qa, replies, transforms
from rasterqa.plans import pairs as pair_plans
from rasterqa.plans.registry import Tables
from rasterqa.sources import catalog, rasters


def chunk(tag, body):
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


def test_dpi_and_size_are_read_by_chunks(spark):
    image = png([[(1, 2, 3, 255)] * 4] * 2, dpi_ppm=2835)
    late = image[:33] + chunk(b"iCCP", b"pHYs" * 2000) + image[33:]
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x02\x01\x00\x3c\x00\x3c\x00\x00\xff\xfe\x17\x72" + b"x" * 6000 + b"\xff\xc0\x00\x11\x08\x4e\x20\x00\x10\x03"
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X\x0a\x00\x00\x00\x00\x00\x00\x00" + (19999).to_bytes(3, "little") + (9).to_bytes(3, "little")
    rows = [("late", late), ("jpeg", jpeg), ("webp", webp), ("none", b"GIF8"), ("cut", late[:40]), ("null", None)]
    files = spark.createDataFrame([(p, len(c or b""), c) for p, c in rows], "path string, length long, content binary")
    dpi = {r.path: (r.dpi, r.dpi_from_file) for r in catalog.with_dpi(files).collect()}
    assert dpi == {"late": (72, True), "jpeg": (60, True), "webp": (300, False), "none": (300, False), "cut": (300, False), "null": (300, False)}
    got = {r.path: (r.width, r.height, r.reason) for r in catalog.validate_images(files).collect()}
    assert got["late"] == (4, 2, None) and got["jpeg"][:2] == (16, 20000) and "too large" in got["jpeg"][2]
    assert got["webp"][:2] == (20000, 10) and "too large" in got["webp"][2]


def test_each_file_is_judged_at_its_own_dpi(spark):
    art = [[(0, 0, 0, 255)] * 12] * 12
    both = pixels(spark, {1: art, 2: art, 3: art})
    files = spark.createDataFrame([(1, None, 300), (2, None, 150), (3, "Empty image.", 300)], "path int, reason string, dpi int")
    seen = {r.image_id: r.dpi for r in qa.qa_measurements(rasters.accepted(both, files)).select("image_id", "dpi").collect()}
    assert seen == {1: 300.0, 2: 150.0}


def test_ring_width_follows_any_side(spark):
    wide = pixels(spark, {1: [[(200, 200, 200, 255 if 20 < x < 1480 else 0) for x in range(1500)]]})
    assert kernels.halo_pct(wide).count() == 1


def test_gcd_of_fibonacci_numbers(spark):
    fib = [1, 1]
    while fib[-1] < 2**62:
        fib.append(fib[-1] + fib[-2])
    rows = spark.createDataFrame(list(zip(fib[1:], fib)) + [(36, 24)], "a long, b long")
    assert {r[0] for r in rows.select(metrics.gcd(F.col("a"), F.col("b"))).collect()} == {1, 12}


def test_blocks_of_any_depth(spark):
    deep = '[{"name": "a", "x": {"y": {"z": {"w": {"v": 1}}}}}, {"name": "b"}, {"name": "cut'
    rows = spark.createDataFrame([(1, deep)], "reply_id int, text string")
    assert [r.name for r in replies.salvage_objects(rows).orderBy("id").collect()] == ["a", "b"]


def test_marks_are_peeled_to_the_end(spark):
    rows = spark.createDataFrame([(1, "- " + "**_" * 9 + "name" + "_**" * 9), (2, "1. plain")], "reply_id int, text string")
    assert sorted(r.item for r in replies.parse_list(rows).collect()) == ["name", "plain"]


def test_long_versions(spark):
    rows = spark.createDataFrame([("1.7.0.0.0.0.5",), ("1.7.0.0.0.0.9",), ("1.7",)], "v string")
    got = [r[0] for r in rows.select(events.version_at_least(F.col("v"), "1.7.0.0.0.0.9")).collect()]
    assert got == [False, True, False]


def test_dots_are_drawn_whole(spark):
    canvas = pixels(spark, {1: [[(0, 0, 0, 255)] * 21] * 21})
    dots = spark.createDataFrame([(1, 10, 10, 8.0)], "image_id int, px int, py int, radius double")
    assert transforms.halftone_pixels(canvas, dots).count() == sum(x * x + y * y <= 64 for x in range(-10, 11) for y in range(-10, 11))


def test_pair_ids_never_meet(spark, tmp_path):
    spark.range(999_990, 1_000_020).withColumnRenamed("id", "vec_id").write.parquet(str(tmp_path / "embeddings.parquet"))
    ids = [r.pair_id for r in pair_plans.pairs_of(Tables(spark, str(tmp_path))).collect()]
    assert len(ids) == len(set(ids)) == 45
