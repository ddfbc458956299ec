"""Borders, backgrounds and content masks over the dense pixel relation.

Every per-image figure is one hash aggregate (partial sums first, so an image of any
size splits over tasks) joined back on ``image_id``; skewed images are split by AQE.
A mask is a boolean column on the pixel relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa import dims
from rasterqa.functions.numbers import luminance, share_where

CHANNELS = ("r", "g", "b")


def with_lum(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("lum", luminance())


def has_alpha(pixels: DataFrame) -> DataFrame:
    """The four readings of "this image is transparent", side by side per image."""
    return pixels.groupBy("image_id").agg(
        F.bool_or(F.col("a") < 255).alias("any_below_255"),
        F.bool_or(F.col("a") < 250).alias("any_below_250"),
        (share_where(F.col("a") < 250) > 0.01).alias("share_below_250"),
    )


def ring_weight(width: Column | int = 1) -> Column:
    """How many of the four border strips hold the pixel (corners lie in two)."""
    width = F.lit(width) if isinstance(width, int) else width
    inside = (
        F.col("x") < width,
        F.col("x") >= F.col("w") - width,
        F.col("y") < width,
        F.col("y") >= F.col("h") - width,
    )
    return sum((c.cast("int") for c in inside[1:]), inside[0].cast("int"))


def frame_width(frac: float = dims.BORDER_FRAC) -> Column:
    return F.greatest(
        F.lit(1), F.rint(F.least("w", "h") * F.lit(frac)).cast("int")
    )


def corner_weight() -> Column:
    """Times a pixel is read when the four corners are sampled."""
    across = (F.col("x") == 0).cast("int") + (F.col("x") == F.col("w") - 1).cast("int")
    down = (F.col("y") == 0).cast("int") + (F.col("y") == F.col("h") - 1).cast("int")
    return across * down


def border_pixels(pixels: DataFrame, frac: float | None = None) -> DataFrame:
    """Border sample with its ``weight`` (strips holding the pixel)."""
    width = F.lit(1) if frac is None else frame_width(frac)
    return pixels.withColumn("weight", ring_weight(width)).filter("weight > 0")


def _weighted_median(channel: str, weight: Column) -> Column:
    return F.percentile(channel, 0.5, weight.cast("bigint"))


def background_colour(pixels: DataFrame, mode: str) -> DataFrame:
    """Per image ``bg_r, bg_g, bg_b``.

    ``corners`` and ``ring`` take medians, ``frame`` a mean over the wide border, and
    ``flat`` the ring median only where at least 70% of the ring lies within 48 of it.
    """
    if mode == "flat":
        ring = border_pixels(pixels)
        median = background_colour(pixels, "ring")
        near = (
            ring.join(median, "image_id")
            .groupBy("image_id", "bg_r", "bg_g", "bg_b")
            .agg(
                (
                    F.sum(F.when(background_distance() <= 48, F.col("weight")).otherwise(0))
                    / F.sum("weight")
                ).alias("near"),
                (F.least(F.first("w"), F.first("h")) >= 3).alias("big_enough"),
            )
        )
        keep = (F.col("near") >= 0.7) & F.col("big_enough")
        return near.select(
            "image_id",
            *[F.when(keep, F.rint(f"bg_{c}")).alias(f"bg_{c}") for c in CHANNELS],
        )
    if mode == "frame":
        sample = border_pixels(pixels, dims.BORDER_FRAC)
        pick = lambda c: F.sum(F.col(c) * F.col("weight")) / F.sum("weight")
    elif mode == "ring":
        sample = border_pixels(pixels)
        pick = lambda c: _weighted_median(c, F.col("weight"))
    elif mode == "corners":
        sample = pixels.withColumn("weight", corner_weight()).filter("weight > 0")
        pick = lambda c: _weighted_median(c, F.col("weight"))
    else:
        raise ValueError(f"unknown background mode {mode!r}")
    return sample.groupBy("image_id").agg(*[pick(c).alias(f"bg_{c}") for c in CHANNELS])


def background_distance() -> Column:
    """Euclidean RGB distance of a pixel from its image's background colour."""
    return F.sqrt(
        sum(
            ((F.col(c) - F.col(f"bg_{c}")) * (F.col(c) - F.col(f"bg_{c}")) for c in CHANNELS[1:]),
            (F.col("r") - F.col("bg_r")) * (F.col("r") - F.col("bg_r")),
        )
    )


def background_type(pixels: DataFrame) -> DataFrame:
    """Transparent / White / Solid colour / Complex from the border's mean and spread."""
    weight = ring_weight(frame_width())
    n = F.sum(weight)
    mean = {c: F.sum(F.col(c) * weight) / n for c in CHANNELS}
    var = {c: F.sum(F.col(c) * F.col(c) * weight) / n - mean[c] * mean[c] for c in CHANNELS}
    agg = pixels.groupBy("image_id").agg(
        F.bool_or(F.col("a") < 255).alias("real_alpha"),
        (F.sum((F.col("r") + F.col("g") + F.col("b")) * weight) / (n * 3)).alias("border_mean"),
        (
            sum((F.sqrt(F.greatest(F.lit(0.0), var[c])) for c in "gb"),
                F.sqrt(F.greatest(F.lit(0.0), var["r"]))) / 3
        ).alias("border_spread"),
    )
    kind = (
        F.when(F.col("real_alpha"), "Transparent")
        .when(F.col("border_spread") > dims.BG_SOLID_STDDEV_MAX, "Complex")
        .when(F.col("border_mean") >= dims.BG_WHITE_MIN, "White")
        .otherwise("Solid colour")
    )
    return agg.withColumn("background_type", kind)


# profile: (alpha below which the image counts as transparent, content alpha, bg mode,
#           colour distance above which an opaque pixel is content)
PROFILES = {
    "compare": (255, 128, "corners", 40.0),
    "qa": (250, 20, "ring", 32.0),
    "geometry": (255, 0, "frame", 40.0),
}


def content_stats(pixels: DataFrame, profile: str) -> DataFrame:
    """One pass per image: is it transparent, and what is its background colour."""
    see_through, _, mode, _ = PROFILES[profile]
    if mode == "frame":
        weight = ring_weight(frame_width())
        pick = lambda c: F.sum(F.col(c) * weight) / F.sum(weight)
    else:
        weight = ring_weight() if mode == "ring" else corner_weight()
        pick = lambda c: _weighted_median(c, weight)
    return pixels.groupBy("image_id").agg(
        F.bool_or(F.col("a") < see_through).alias("has_alpha"),
        *[pick(c).alias(f"bg_{c}") for c in CHANNELS],
    )


def content_mask(pixels: DataFrame, profile: str) -> DataFrame:
    """Add ``has_alpha`` and ``content``: opaque enough, or unlike the background."""
    _, alpha, _, distance = PROFILES[profile]
    joined = pixels.join(content_stats(pixels, profile), "image_id")
    content = F.when(F.col("has_alpha"), F.col("a") > alpha).otherwise(
        background_distance() > distance
    )
    return joined.withColumn("content", content).drop("bg_r", "bg_g", "bg_b")


def is_opaque_white(pixels: DataFrame, tolerance: int = 12) -> DataFrame:
    """All four corners fully opaque and near white."""
    floor = 255 - tolerance
    white = (F.col("a") == 255) & (F.least("r", "g", "b") >= floor)
    corners = pixels.filter(corner_weight() > 0)
    return corners.groupBy("image_id").agg(F.bool_and(white).alias("opaque_white"))
