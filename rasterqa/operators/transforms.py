"""Row-level raster transforms: background removal, padding, crops, halftone, resize."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterqa import dims
from rasterqa.functions.numbers import count_where, half_even, luminance
from rasterqa.operators import components as cc
from rasterqa.operators import kernels, masks, metrics


def content_mask_connected(pixels: DataFrame) -> DataFrame:
    """Content for comparison: alpha above 128, or, on opaque images, everything that is
    not border-connected background. Enclosed background colour stays content."""
    stats = masks.content_stats(pixels, "compare")
    joined = pixels.join(stats, "image_id").withColumn(
        "near_bg", ~F.col("has_alpha") & (masks.background_distance() <= 40.0)
    )
    marked = cc.border_connected(joined, "near_bg", "is_bg")
    return marked.withColumn(
        "content", F.when(F.col("has_alpha"), F.col("a") > 128).otherwise(~F.col("is_bg"))
    ).drop("near_bg", "is_bg", "bg_r", "bg_g", "bg_b")


def remove_background(pixels: DataFrame, mode: str = "white", tolerance: int | None = None) -> DataFrame:
    """Clear the alpha of background reached from the border; enclosed matches stay.

    ``white``: every channel at least 255 - 12. ``flat``: within 48 of the uniform ring
    colour; images whose ring is not uniform are returned as they are.
    """
    if mode == "white":
        near = F.least("r", "g", "b") >= 255 - (12 if tolerance is None else tolerance)
        marked = pixels.withColumn("near_bg", near)
    else:
        bg = masks.background_colour(pixels, "flat")
        marked = pixels.join(bg, "image_id").withColumn(
            "near_bg",
            F.coalesce(masks.background_distance() <= (48 if tolerance is None else tolerance), F.lit(False)),
        ).drop("bg_r", "bg_g", "bg_b")
    reached = cc.border_connected(marked, "near_bg", "is_bg")
    return reached.withColumn("a", F.when(F.col("is_bg"), 0).otherwise(F.col("a"))).drop("near_bg", "is_bg")


def padded_size(w: Column, h: Column, ratio: Column) -> tuple[Column, Column]:
    """Canvas that holds ``w x h`` at the target ratio, growing one side only."""
    current = w / h
    same = F.abs(current - ratio) < 1e-6
    wider = current > ratio
    new_h = F.when(~same & wider, F.greatest(half_even(w / ratio).cast("int"), h)).otherwise(h)
    new_w = F.when(~same & ~wider, F.greatest(half_even(h * ratio).cast("int"), w)).otherwise(w)
    return new_w, new_h


def fit_to_ratio(pixels: DataFrame, ratio: Column) -> DataFrame:
    """Centre on a canvas of the target ratio. Padding stays implicit (sparse): only
    the size and coordinates change, and no pixel is cropped or scaled."""
    new_w, new_h = padded_size(F.col("w"), F.col("h"), ratio)
    moved = pixels.withColumn("nw", new_w).withColumn("nh", new_h)
    shift = lambda new, old: F.floor((F.col(new) - F.col(old)) / 2).cast("int")
    return (
        moved.withColumn("x", F.col("x") + shift("nw", "w")).withColumn("y", F.col("y") + shift("nh", "h"))
        .withColumn("w", F.col("nw")).withColumn("h", F.col("nh")).drop("nw", "nh")
    )


def fill_canvas(sparse: DataFrame, values: dict[str, int], keys=("image_id",)) -> DataFrame:
    """Dense raster from a sparse one: missing coordinates take the given values."""
    size = sparse.groupBy(*keys).agg(F.first("w").alias("w"), F.first("h").alias("h"))
    grid = size.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    filled = grid.join(sparse.drop("w", "h"), [*keys, "x", "y"], "left")
    return filled.select(
        *keys, "w", "h", "x", "y",
        *[F.coalesce(c, F.lit(v)).alias(c) for c, v in values.items()],
    )


BUCKET = 256


def crop_boxes(pixels: DataFrame, boxes: DataFrame, pad: int = 8) -> DataFrame:
    """Cut boxes ``(image_id, n, x, y, w, h)`` out of their images, padded and clamped.

    Range join as an equi-join on (image, x-bucket, y-bucket): a box is repeated per
    bucket it covers, pixels stay single. Empty boxes vanish. Crops are re-based to 0,0.
    """
    wanted = boxes.select("image_id", "n", *[F.col(c).alias(f"b{c}") for c in "xywh"])
    size = pixels.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    edges = wanted.join(size, "image_id").select(
        "image_id", "n",
        F.greatest(F.lit(0), F.col("bx") - pad).alias("x0"),
        F.greatest(F.lit(0), F.col("by") - pad).alias("y0"),
        F.least(F.col("w"), F.col("bx") + F.col("bw") + pad).alias("x1"),
        F.least(F.col("h"), F.col("by") + F.col("bh") + pad).alias("y1"),
    ).filter("x1 > x0 and y1 > y0")
    return cut_ranges(pixels, edges)


def cut_ranges(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """Pixels inside each ``(image_id, n, x0, y0, x1, y1)``, ends exclusive."""
    span = lambda lo, hi: F.explode(
        F.sequence(F.floor(F.col(lo) / BUCKET), F.floor((F.col(hi) - 1) / BUCKET)))
    tiled = edges.select("*", span("x0", "x1").alias("tx")).select("*", span("y0", "y1").alias("ty"))
    located = pixels.withColumn("tx", F.floor(F.col("x") / BUCKET)).withColumn("ty", F.floor(F.col("y") / BUCKET))
    hit = located.join(tiled, ["image_id", "tx", "ty"]).filter(
        (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
        & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    )
    return hit.select(
        "image_id", "n", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"),
        (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "r", "g", "b", "a",
    )


def grid_split(pixels: DataFrame, cols: int, rows: int, inset_pct: float = 4.0) -> DataFrame:
    """Equal cells by integer division, inset a little where over 10 px would remain."""
    cw, ch = F.floor(F.col("w") / cols).cast("int"), F.floor(F.col("h") / rows).cast("int")
    celled = pixels.withColumn("cw", cw).withColumn("ch", ch).filter(
        (F.col("x") < F.col("cw") * cols) & (F.col("y") < F.col("ch") * rows)
    )
    ix = F.floor(F.col("cw") * inset_pct / 100).cast("int")
    iy = F.floor(F.col("ch") * inset_pct / 100).cast("int")
    inset = (F.col("cw") - 2 * ix > 10) & (F.col("ch") - 2 * iy > 10) & F.lit(inset_pct > 0)
    placed = celled.select(
        "image_id", (F.floor(F.col("y") / F.col("ch")) * cols + F.floor(F.col("x") / F.col("cw"))).cast("int").alias("n"),
        F.when(inset, ix).otherwise(0).alias("ix"), F.when(inset, iy).otherwise(0).alias("iy"), "cw", "ch",
        (F.col("x") % F.col("cw")).alias("cx"), (F.col("y") % F.col("ch")).alias("cy"), "r", "g", "b", "a",
    )
    kept = placed.filter(
        (F.col("cx") >= F.col("ix")) & (F.col("cx") < F.col("cw") - F.col("ix"))
        & (F.col("cy") >= F.col("iy")) & (F.col("cy") < F.col("ch") - F.col("iy"))
    )
    return kept.select(
        "image_id", "n", (F.col("cw") - 2 * F.col("ix")).alias("w"), (F.col("ch") - 2 * F.col("iy")).alias("h"),
        (F.col("cx") - F.col("ix")).alias("x"), (F.col("cy") - F.col("iy")).alias("y"), "r", "g", "b", "a",
    )


def validate_crops(crops: DataFrame) -> DataFrame:
    """Warnings per crop ``(image_id, n)``: cut-off edge, odd size, odd shape.

    Medians are taken over the crops of one sheet as an aggregate, then joined back.
    """
    see = F.col("a") > 128
    on = lambda cond: F.sum(F.when(cond & see, 1).otherwise(0))
    info = crops.groupBy("image_id", "n", "w", "h").agg(
        F.bool_or(F.col("a") < 250).alias("clear"), count_where(see).alias("opaque_px"),
        (on(F.col("y") == 0) / F.first("w")).alias("top"),
        (on(F.col("y") == F.col("h") - 1) / F.first("w")).alias("bottom"),
        (on(F.col("x") == 0) / F.first("h")).alias("left"),
        (on(F.col("x") == F.col("w") - 1) / F.first("h")).alias("right"),
    )
    sides = ["top", "bottom", "left", "right"]
    touched = sum(((F.col(s) > 0).cast("int") for s in sides[1:]), (F.col("top") > 0).cast("int"))
    flagged = info.select(
        "image_id", "n", "w", "h",
        (F.col("clear") & ((touched > 2) | (F.greatest(*sides) > 0.6))).alias("touches"),
        F.when(F.col("clear"), F.col("opaque_px")).otherwise(F.col("w") * F.col("h")).cast("bigint").alias("area"),
        (F.col("w") / F.greatest("h", F.lit(1))).alias("aspect"),
    )
    middle = flagged.groupBy("image_id").agg(
        F.percentile("area", 0.5).alias("m_area"), F.percentile("aspect", 0.5).alias("m_aspect"))
    off = lambda c, m, tol: (F.col(m) > 0) & (F.abs(F.col(c) - F.col(m)) > F.col(m) * tol)
    text = F.concat_ws(
        "; ",
        F.when(F.col("touches"), "Content touches edge (may be cut off)"),
        F.when(off("area", "m_area", 0.6), "Unusual size"),
        F.when(off("aspect", "m_aspect", 0.5), "Unusual shape"),
    )
    return flagged.join(middle, "image_id").select(
        "image_id", "n", "area", "touches", F.when(text != "", text).alias("warning"))


def black_out(pixels: DataFrame, threshold: int = 40, feather: int = 1) -> DataFrame:
    """Knock black out: visible pixels dark in every channel lose their alpha.

    With a feather the mask is blurred (sigma = feather) and alpha fades by it.
    """
    black = (F.greatest("r", "g", "b") < threshold) & (F.col("a") > 0)
    if feather <= 0:
        return pixels.withColumn("a", F.when(black, 0).otherwise(F.col("a")))
    masked = pixels.withColumn("black", F.when(black, 255.0).otherwise(0.0))
    taps = kernels.gaussian_taps(2 * math.ceil(3 * feather) + 1, float(feather))
    soft = kernels.separable(masked, {"soft": ("black", taps, taps)})
    faded = F.floor(F.col("a") * (1 - F.rint("soft") / 255.0)).cast("int")
    return soft.withColumn("a", F.greatest(F.lit(0), faded)).drop("black", "soft")


def halftone_cells(pixels: DataFrame, lpi: float = 40.0, angle: float = 22.5, dpi: float = 300.0,
                   min_radius: float = 0.6) -> DataFrame:
    """Dot table ``(image_id, gi, gj, px, py, radius)`` of a rotated halftone grid.

    A pixel can only fall into the windows of grid points near it, so each pixel names
    those points itself (a fixed 5x5 patch around its own cell) and the sums combine
    before the shuffle: no grid table, no range join.
    """
    if lpi <= 0 or dpi <= 0:
        raise ValueError("lpi and dpi must be positive.")
    cell = max(2.0, dpi / lpi)
    half = math.ceil(cell / 2)
    cos_t, sin_t = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    cx, cy = F.col("w") / 2.0, F.col("h") / 2.0
    dx, dy = F.col("x") - cx, F.col("y") - cy
    u0 = F.rint((dx * cos_t + dy * sin_t) / cell).cast("int")
    v0 = F.rint((dy * cos_t - dx * sin_t) / cell).cast("int")
    span = F.sequence(F.lit(-2), F.lit(2))
    near = (
        pixels.withColumn("u0", u0).withColumn("v0", v0)
        .withColumn("ink", 1.0 - luminance() / 255.0).withColumn("cover", F.col("a") / 255.0)
        .select("*", F.explode(span).alias("du")).select("*", F.explode(span).alias("dv"))
        .withColumn("gi", F.col("u0") + F.col("du")).withColumn("gj", F.col("v0") + F.col("dv"))
    )
    grid = lambda i, j: (i * cell, j * cell)
    u, v = grid(F.col("gi"), F.col("gj"))
    placed = near.withColumn("px", F.rint(cx + u * cos_t - v * sin_t).cast("int")).withColumn(
        "py", F.rint(cy + u * sin_t + v * cos_t).cast("int")
    ).filter("px >= 0 and px < w and py >= 0 and py < h").filter(
        (F.abs(F.col("x") - F.col("px")) <= half) & (F.abs(F.col("y") - F.col("py")) <= half)
    )
    cells = placed.groupBy("image_id", "gi", "gj", "px", "py").agg(
        F.avg("cover").alias("coverage"), F.sum("cover").alias("sum_cover"),
        F.sum(F.col("ink") * F.col("cover")).alias("sum_ink"),
    )
    tone = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sum_ink") / F.greatest("sum_cover", F.lit(1e-6))))
    dots = cells.filter("coverage >= 0.5").withColumn("radius", F.sqrt(tone) * (cell / 2))
    return dots.filter(F.col("radius") >= min_radius).select("image_id", "gi", "gj", "px", "py", "radius")


def halftone_pixels(pixels: DataFrame, dots: DataFrame, shape: str = "round") -> DataFrame:
    """Draw the dots: each dot names the pixels of its own box, kept inside the radius and
    where the artwork covers at least half."""
    reach = F.ceil("radius").cast("int")
    box = F.sequence(-reach, reach)
    spots = dots.select("image_id", "radius", "px", "py", F.explode(box).alias("ox")).select(
        "*", F.explode(box).alias("oy"))
    inside = (
        (F.abs("ox") <= F.col("radius")) & (F.abs("oy") <= F.col("radius")) if shape == "square"
        else F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy") <= F.col("radius") * F.col("radius")
    )
    inked = spots.filter(inside).select(
        "image_id", (F.col("px") + F.col("ox")).alias("x"), (F.col("py") + F.col("oy")).alias("y")).distinct()
    covered = pixels.filter(F.col("a") / 255.0 >= 0.5).select("image_id", "w", "h", "x", "y")
    return covered.join(inked, ["image_id", "x", "y"], "left_semi")


def fitted_size(w: Column, h: Column, tw: Column, th: Column) -> tuple[Column, Column]:
    """Largest size inside the target keeping the aspect."""
    scale = F.least(tw / w, th / h)
    fit = lambda side: F.greatest(F.lit(1), half_even(side * scale).cast("int"))
    return fit(w), fit(h)


def print_ready_plan(pixels: DataFrame, target_w: int, target_h: int) -> DataFrame:
    """Trim, fit and pad sizes per image: the visible box inside the target, unstretched."""
    seen = metrics.bbox(pixels.withColumn("seen", F.col("a") > 0), "seen")
    trim = seen.select(
        "image_id", "w", "h",
        F.coalesce("bx", F.lit(0)).alias("tx"), F.coalesce("by", F.lit(0)).alias("ty"),
        F.coalesce("bw", "w").cast("int").alias("fw"), F.coalesce("bh", "h").cast("int").alias("fh"),
    ).withColumn("trimmed", (F.col("fw") != F.col("w")) | (F.col("fh") != F.col("h")))
    tw, th = F.lit(target_w), F.lit(target_h)
    off = (F.abs(F.col("fw") - tw) > 2) | (F.abs(F.col("fh") - th) > 2)
    fit_w, fit_h = fitted_size(F.col("fw"), F.col("fh"), tw, th)
    sized = trim.withColumn("fit_w", F.when(off, fit_w).otherwise(F.col("fw"))).withColumn(
        "fit_h", F.when(off, fit_h).otherwise(F.col("fh")))
    return sized.select(
        "*",
        (off & ((F.col("fit_w") != F.col("fw")) | (F.col("fit_h") != F.col("fh")))).alias("resized"),
        (off & ((F.col("fit_w") != tw) | (F.col("fit_h") != th))).alias("padded"),
        F.when(off, tw).otherwise(F.col("fw")).alias("out_w"),
        F.when(off, th).otherwise(F.col("fh")).alias("out_h"),
    )


def make_print_ready(pixels: DataFrame, target_w: int, target_h: int, dpi: int = 300,
                     alpha_cut: int = 120) -> DataFrame:
    """Report per image of the normalised print file: sizes and hard-cut alpha counts."""
    plan = print_ready_plan(pixels, target_w, target_h)
    inner = pixels.join(plan.drop("w", "h"), "image_id").filter(
        (F.col("x") >= F.col("tx")) & (F.col("x") < F.col("tx") + F.col("fw"))
        & (F.col("y") >= F.col("ty")) & (F.col("y") < F.col("ty") + F.col("fh"))
    ).select(
        "image_id", F.col("fw").alias("w"), F.col("fh").alias("h"),
        (F.col("x") - F.col("tx")).alias("x"), (F.col("y") - F.col("ty")).alias("y"), "a", "fit_w", "fit_h",
    )
    fitted = kernels.resample(inner, ["a"], F.col("fit_w"), F.col("fit_h"))
    level = half_even(F.round("a", 6))
    partial = (level > 0) & (level < 255)
    cut = fitted.groupBy("image_id").agg(
        count_where(partial).alias("changed_px"),
        count_where(partial & (level < alpha_cut)).alias("became_clear"),
        count_where(partial & (level >= alpha_cut)).alias("became_opaque"),
    )
    inches = lambda c: half_even(F.col(c) / F.lit(float(dpi)), 2)
    return plan.join(cut, "image_id").select(
        "image_id", "trimmed", "resized", "padded", "fw", "fh", "fit_w", "fit_h", "out_w", "out_h",
        "changed_px", "became_clear", "became_opaque",
        (F.col("changed_px") > 0).alias("thresholded"),
        inches("out_w").alias("width_in"), inches("out_h").alias("height_in"),
    )


def print_ready_summary(dpi: int = 300) -> Column:
    return F.concat(
        F.lit("Print ready: "), F.col("out_w"), F.lit(" x "), F.col("out_h"),
        F.lit(f" px @ {dpi} DPI = "), F.col("width_in"), F.lit(" x "), F.col("height_in"), F.lit(" in"),
    )


def composite_on_swatch(pixels: DataFrame, swatches: DataFrame, size: int = 600,
                        margin: float = 0.12) -> DataFrame:
    """Art scaled into the inner square and alpha-blended on its garment colour.

    ``swatches(image_id, sr, sg, sb)``. Returns the covered pixels; everywhere else the
    swatch is its flat colour.
    """
    avail = F.lit(int(size * (1.0 - 2.0 * margin)))
    new_w, new_h = fitted_size(F.col("w"), F.col("h"), avail, avail)
    art = kernels.resample(pixels, ["r", "g", "b", "a"], new_w, new_h)
    ox, oy = F.floor((size - F.col("w")) / 2), F.floor((size - F.col("h")) / 2)
    share = F.col("a") / 255.0
    blend = lambda c: half_even(F.round(F.col(c) * share + F.col(f"s{c}") * (1 - share), 6)).cast("int").alias(c)
    return art.join(swatches, "image_id").select(
        "image_id", F.lit(size).alias("w"), F.lit(size).alias("h"),
        (F.col("x") + ox).cast("int").alias("x"), (F.col("y") + oy).cast("int").alias("y"),
        blend("r"), blend("g"), blend("b"),
    )


def neutral_grey(masked: DataFrame, long_side: int = dims.COMPARE_LONG_SIDE,
                 pad: int = dims.COMPARE_PAD) -> DataFrame:
    """Background-free grey view: flatten on mid grey, crop to content, scale the long
    side, pad. Dense result ``(image_id, w, h, x, y, grey, content)``, grey 0..255."""
    share = F.col("a") / 255.0
    flat = lambda c: F.floor(F.when(
        F.col("content"), F.col(c) * share + dims.NEUTRAL_GREY * (1 - share)
    ).otherwise(float(dims.NEUTRAL_GREY)))
    grey = half_even((flat("r") * 299 + flat("g") * 587 + flat("b") * 114) / 1000)
    box = metrics.bbox(masked).select(
        "image_id", F.coalesce("bx", F.lit(0)).alias("tx"), F.coalesce("by", F.lit(0)).alias("ty"),
        F.coalesce("bw", "w").cast("int").alias("cw"), F.coalesce("bh", "h").cast("int").alias("ch"),
    )
    cropped = masked.withColumn("grey", grey).join(box, "image_id").filter(
        (F.col("x") >= F.col("tx")) & (F.col("x") < F.col("tx") + F.col("cw"))
        & (F.col("y") >= F.col("ty")) & (F.col("y") < F.col("ty") + F.col("ch"))
    ).select(
        "image_id", F.col("cw").alias("w"), F.col("ch").alias("h"), (F.col("x") - F.col("tx")).alias("x"),
        (F.col("y") - F.col("ty")).alias("y"), "grey", F.col("content").cast("int").alias("content"),
    )
    scale = F.lit(float(long_side)) / F.greatest("w", "h")
    new = lambda c: F.greatest(F.lit(1), half_even(F.col(c) * scale).cast("int"))
    return pad_view(fit_view(cropped, new("w"), new("h")), pad)


def fit_view(view: DataFrame, new_w: Column, new_h: Column) -> DataFrame:
    """Resize a grey view: area-weighted grey, nearest mask."""
    grey = kernels.resample(view, ["grey"], new_w, new_h)
    mask = kernels.resample_nearest(view, ["content"], new_w, new_h).drop("w", "h")
    return grey.join(mask, ["image_id", "x", "y"]).withColumn("grey", half_even(F.round("grey", 6)))


def pad_view(view: DataFrame, pad: int) -> DataFrame:
    if pad == 0:
        return view
    moved = view.select(
        "image_id", (F.col("w") + 2 * pad).alias("w"), (F.col("h") + 2 * pad).alias("h"),
        (F.col("x") + pad).alias("x"), (F.col("y") + pad).alias("y"), "grey", "content",
    )
    return fill_canvas(moved, {"grey": float(dims.NEUTRAL_GREY), "content": 0})


def prefer_transparent(images: DataFrame, group: str, opaque: str) -> DataFrame:
    """Drop opaque-background duplicates where the group also has a transparent one."""
    clear = images.groupBy(group).agg(F.bool_or(~F.col(opaque)).alias("any_clear"))
    return images.join(clear, group).filter(~F.col("any_clear") | ~F.col(opaque)).drop("any_clear")
