"""From image files on disk to the report."""

import struct

from pyspark.sql import functions as F

from conftest import canvas, png
from rasterqa.operators import qa
from rasterqa.sources import catalog, rasters

ART = canvas(16, 16, (255, 255, 255, 255), (4, 4, 8, 8), (20, 20, 20, 255))


def write_jpeg(spark, path, rows):
    """A JPEG of the JVM's own writer."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(len(rows[0]), len(rows), 1)
    for y, row in enumerate(rows):
        for x, (r, g, b, _) in enumerate(row):
            image.setRGB(x, y, r << 16 | g << 8 | b)
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


def with_exif(raw, density, unit):
    """The JPEG with an Exif block in place of its JFIF one."""
    size = struct.unpack(">H", raw[4:6])[0]
    tiff = b"II*\x00\x08\x00\x00\x00" + struct.pack("<H", 2) + struct.pack("<HHII", 0x011A, 5, 1, 38) + struct.pack("<HHIHH", 0x0128, 3, 1, unit, 0) + b"\x00" * 4
    body = b"Exif\x00\x00" + tiff + struct.pack("<II", density * 10, 10)
    return raw[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + raw[4 + size:]


def test_files_reach_the_report(spark, tmp_path):
    folder = tmp_path / "new art+100%20 ü"
    folder.mkdir()
    (folder / "a b.png").write_bytes(png(ART, dpi_ppm=5906))
    write_jpeg(spark, folder / "photo.jpg", ART)
    raw = (folder / "photo.jpg").read_bytes()
    (folder / "photo.jpg").write_bytes(with_exif(raw, 200, 2))
    (folder / "metric.jpg").write_bytes(with_exif(raw, 100, 3))
    (folder / "empty.png").write_bytes(b"")  # Spark's file sources list no file without bytes
    (folder / "text.png").write_bytes(b"no image")
    files = catalog.inspect_folder(spark, f"file://{folder}")
    seen = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert {k: (r.dpi, r.reason is None) for k, r in seen.items()} == {
        "a b.png": (150, True), "photo.jpg": (200, True), "metric.jpg": (254, True), "text.png": (300, False)}
    assert (seen["photo.jpg"].width, seen["photo.jpg"].height) == (16, 16)
    good = {r.path for r in seen.values() if r.reason is None}
    px = rasters.read_pixels(spark, str(folder), files)
    assert {(r.image_id, r.dpi, r["count"]) for r in px.groupBy("image_id", "dpi").count().collect()} == {(r.path, r.dpi, 256) for r in seen.values() if r.path in good}
    late = rasters.accepted(rasters.read_pixels(spark, str(folder)), files)
    assert late.count() == 3 * 256 and sorted(late.columns) == sorted(px.columns)
    report = qa.qa_report(qa.qa_checks(qa.qa_measurements(px))).collect()
    assert {r.image_id for r in report} == good and all(0 <= r.score <= 100 for r in report)


def test_one_spelling_of_a_path(spark):
    rows = spark.createDataFrame([("file:///a/b%20c%2B+.png", "file:/a/b c++.png"), ("s3a://bucket/x%25.png", "s3a://bucket/x%.png")], "i string, b string")
    for r in rows.select(rasters.file_key(F.col("i"), escaped=True).alias("i"), rasters.file_key(F.col("b")).alias("b")).collect():
        assert r.i == r.b
