"""Raster relations.

``pixels(image_id, w, h, x, y, r, g, b, a)`` is dense: one row per coordinate.
Canvas size rides along, so no operator needs a join to learn it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL_COLUMNS = ["image_id", "w", "h", "x", "y", "r", "g", "b", "a"]


def rasters_from_embeddings(embeddings: DataFrame, opaque: bool = False) -> DataFrame:
    """One 8x8 RGBA raster per 64-long vector (FIXTURES.md, relations RX and RXO)."""
    level = lambda v: F.least(
        F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.5) * 255))
    ).cast("int")
    alpha = lambda v: (
        F.when(v.cast("double") < -0.15, 0).when(v.cast("double") < -0.05, 128).otherwise(255)
    )
    base = embeddings.select(
        F.col("vec_id").alias("image_id"),
        F.transform("embedding", level).alias("q"),
        F.transform("embedding", alpha).alias("al"),
    )
    wide = base.select("image_id", "q", "al", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    at = lambda arr, shift: F.get(arr, ((F.col("i") + shift) % 64).cast("int"))
    return wide.select(
        "image_id",
        F.lit(8).alias("w"),
        F.lit(8).alias("h"),
        (F.col("i") % 8).cast("int").alias("x"),
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        at("q", 0).alias("r"),
        at("q", 21).alias("g"),
        at("q", 42).alias("b"),
        (F.lit(255) if opaque else at("al", 0)).cast("int").alias("a"),
    )


STRIP_PIXELS = 1 << 18


def _decode_strips(batches):
    """Unpack BGR(A) bytes to pixel rows, a strip of scanlines at a time."""
    for batch in batches:
        for img in batch.itertuples(index=False):
            rows_per_strip = max(1, STRIP_PIXELS // img.width)
            stride = img.width * img.nc
            for y0 in range(0, img.height, rows_per_strip):
                n = min(rows_per_strip, img.height - y0)
                raw = np.frombuffer(img.data, np.uint8, n * stride, y0 * stride)
                ch = raw.reshape(-1, img.nc).astype(np.int32)
                b, g, r = (ch[:, min(k, img.nc - 1)] for k in (0, 1, 2))
                yield pd.DataFrame({
                    "image_id": img.image_id, "w": np.int32(img.width), "h": np.int32(img.height),
                    "x": np.tile(np.arange(img.width, dtype=np.int32), n),
                    "y": np.repeat(np.arange(y0, y0 + n, dtype=np.int32), img.width),
                    "r": r, "g": g, "b": b,
                    "a": ch[:, 3] if img.nc == 4 else np.int32(255),
                    **({"dpi": np.int32(img.dpi)} if "dpi" in batch.columns else {}),
                })


def file_key(path: Column, escaped: bool = False) -> Column:
    """One spelling of a file's address: ``file:/a b.png`` for ``file:///a%20b.png`` too.

    Spark's image source percent-escapes (``escaped``), its binaryFile source doesn't. An authority
    (``s3a://bucket/``) stays. A path that is no text is left as it is.
    """
    text = path.cast("string")
    if escaped:
        text = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return F.regexp_replace(text, r"^([A-Za-z][A-Za-z0-9+.-]*):///+", "$1:/")


def read_pixels(spark, path: str, files: DataFrame | None = None) -> DataFrame:
    """Decode a folder of images to pixel rows with Spark's image source.

    ``image_id`` is the file's address as binaryFile spells it. Files the decoder cannot read come
    back with height -1 and are left out here; ``inspect_files`` reports them. With ``files``
    (``path, reason, dpi`` of ``inspect_files``) only files without a reason are decoded, and their
    ``dpi`` rides along.
    """
    img = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    good = img.filter(F.col("height") > 0).select(
        file_key(F.col("origin"), escaped=True).alias("image_id"), "width", "height",
        F.col("nChannels").alias("nc"), "data",
    )
    schema = "image_id string, w int, h int, x int, y int, r int, g int, b int, a int"
    if files is None:
        return good.mapInPandas(_decode_strips, schema)
    passed = files.filter("reason is null").select(file_key(F.col("path")).alias("image_id"), "dpi")
    return good.join(passed, "image_id").mapInPandas(_decode_strips, schema + ", dpi int")


def accepted(pixels: DataFrame, files: DataFrame) -> DataFrame:
    """Pixels of the files that pass, with each file's ``dpi``.

    ``files(path, reason, dpi)``: one row per image from ``inspect_files``; ``path`` may be spelt as
    either of Spark's file sources does, or be any other id that the pixels carry.
    """
    if dict(pixels.dtypes)["image_id"] == "string":
        good = files.filter("reason is null").select(file_key(F.col("path")).alias("_key"), "dpi")
        return pixels.withColumn("_key", file_key(F.col("image_id"))).join(good, "_key").drop("_key")
    good = files.filter("reason is null").select(F.col("path").alias("image_id"), "dpi")
    return pixels.join(good, "image_id")
