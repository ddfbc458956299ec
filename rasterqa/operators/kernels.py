"""Neighbourhood operators on the dense pixel relation, as two ordered passes.

A filter or structuring element is applied along rows (window per image row) and then
along columns (window per image column). That costs two shuffles whatever the kernel
size, where a join with kernel offsets would multiply the pixels by its area, and no
window ever holds more than one row or column of one image.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterqa import dims
from rasterqa.functions.numbers import count_where, half_even, luminance
from rasterqa.operators import components as cc
from rasterqa.operators.envelopes import column_pass, stroke_of_copies
from rasterqa.session import cut_lineage

Keys = tuple[str, ...]
IMAGE: Keys = ("image_id",)


def ellipse(radius: int) -> dict[int, int]:
    """Row offset -> half width of the filled ellipse of the given radius."""
    return {
        dy: round(math.sqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)
    }


def box(radius: int) -> dict[int, int]:
    return {dy: radius for dy in range(-radius, radius + 1)}


CROSS = {-1: 0, 0: 1, 1: 0}


def _along_x(keys: Keys) -> Window:
    return Window.partitionBy(*keys, "y").orderBy("x")


def _along_y(keys: Keys) -> Window:
    return Window.partitionBy(*keys, "x").orderBy("y")


def _at(col: str, offset: int, order) -> Column:
    """The value ``offset`` steps further on; NULL outside the raster."""
    if offset == 0:
        return F.col(col)
    return F.lead(col, offset).over(order) if offset > 0 else F.lag(col, -offset).over(order)


def morph(pixels: DataFrame, jobs: dict[str, tuple[str, dict[int, int], str]],
          keys: Keys = IMAGE) -> DataFrame:
    """Grey or binary dilation and erosion, all jobs sharing the two passes.

    ``jobs`` maps an output column to ``(input column, kernel, "max" | "min")``.
    Coordinates outside the raster are ignored, as in flat morphology.
    """
    row, col = _along_x(keys), _along_y(keys)
    passes: dict[str, Column] = {}
    for out, (src, kernel, op) in jobs.items():
        agg = F.max if op == "max" else F.min
        for half in set(kernel.values()):
            passes[f"_{out}_{half}"] = agg(src).over(row.rowsBetween(-half, half))
    rowed = pixels.select("*", *[c.alias(n) for n, c in passes.items()])
    outs = []
    for out, (_, kernel, op) in jobs.items():
        pick = F.greatest if op == "max" else F.least
        terms = [_at(f"_{out}_{half}", dy, col) for dy, half in kernel.items()]
        outs.append((pick(*terms) if len(terms) > 1 else terms[0]).alias(out))
    return rowed.select("*", *outs).drop(*passes)


def pad_reflect(pixels: DataFrame, reach: int, keys: Keys = IMAGE) -> DataFrame:
    """Repeat border pixels mirrored about the edge (the edge itself not doubled)."""
    def mirrored(c: str, size: str) -> Column:
        last = F.col(size) - 1
        spots = F.array(F.col(c), -F.col(c), 2 * last - F.col(c))
        inside = F.filter(F.array_distinct(spots), lambda v: (v >= -reach) & (v <= last + reach))
        return F.when(F.col(size) == 1, F.sequence(F.lit(-reach), F.lit(reach))).otherwise(inside)

    others = [c for c in pixels.columns if c not in ("x", "y")]
    wide = pixels.select(*others, "y", F.explode(mirrored("x", "w")).alias("x"))
    return wide.select(*others, "x", F.explode(mirrored("y", "h")).alias("y"))


def separable(pixels: DataFrame, jobs: dict[str, tuple[str, list[float], list[float]]],
              keys: Keys = IMAGE) -> DataFrame:
    """Correlate columns with separable kernels under mirrored borders.

    ``jobs`` maps an output column to ``(input column, row taps, column taps)``; every
    tap list has the same odd length. One padded copy and two passes serve all jobs.
    """
    reach = max(len(t) for j in jobs.values() for t in j[1:]) // 2
    padded = pad_reflect(pixels, reach, keys)
    row, col = _along_x(keys), _along_y(keys)

    def apply(name: str, taps: list[float], order) -> Column:
        mid = len(taps) // 2
        terms = [F.lit(float(t)) * _at(name, i - mid, order) for i, t in enumerate(taps) if t]
        return sum(terms[1:], terms[0])

    by_row = {f"_{out}": apply(src, rt, row) for out, (src, rt, _) in jobs.items()}
    rowed = padded.select("*", *[c.alias(n) for n, c in by_row.items()]).filter(
        (F.col("x") >= 0) & (F.col("x") < F.col("w"))
    )
    done = rowed.select(
        "*", *[apply(f"_{out}", ct, col).alias(out) for out, (_, _, ct) in jobs.items()]
    )
    return done.filter((F.col("y") >= 0) & (F.col("y") < F.col("h"))).drop(*by_row)


def gaussian_taps(size: int, sigma: float) -> list[float]:
    """Normalised Gaussian taps; a 3-tap kernel with no sigma is binomial."""
    if sigma <= 0:
        return [0.25, 0.5, 0.25] if size == 3 else gaussian_taps(size, 0.3 * ((size - 1) * 0.5 - 1) + 0.8)
    mid = size // 2
    raw = [math.exp(-((i - mid) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [v / sum(raw) for v in raw]


SMOOTH, DIFF = [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0]


def gradient(pixels: DataFrame, src: str = "level", keys: Keys = IMAGE) -> DataFrame:
    """Add ``gx``, ``gy`` and ``mag`` (3x3 Sobel)."""
    out = separable(pixels, {"gx": (src, DIFF, SMOOTH), "gy": (src, SMOOTH, DIFF)}, keys)
    return out.withColumn("mag", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def level8(col: Column) -> Column:
    """Luminance cut to an 8-bit level (fraction dropped)."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), col))).cast("double")


def distance_to(pixels: DataFrame, targets: dict[str, str], keys: Keys = IMAGE,
                only: str | None = None, bound: int | None = None) -> DataFrame:
    """Exact Euclidean distance to the nearest pixel of each set (NULL if it is empty).

    ``targets`` maps an output column to a boolean column. Row pass: nearest member in
    the row, from the last one before and the first one after. Column pass: the lower envelope
    of ``dy^2 + d^2`` down the column, linear in its pixels. With ``only``, a boolean column,
    distances are returned for its pixels alone. With ``bound`` (pixels) only members that near
    count, further ones give NULL, and both passes are windows of that width.
    """
    row = _along_x(keys)
    reach = Window.unboundedFollowing if bound is None else bound
    back, ahead = row.rowsBetween(-reach, 0), row.rowsBetween(0, reach)
    near = []
    for out, flag in targets.items():
        here = F.when(F.col(flag), F.col("x"))
        left = F.col("x") - F.last(here, ignorenulls=True).over(back)
        right = F.first(here, ignorenulls=True).over(ahead) - F.col("x")
        near.append(F.least(left, right).alias(f"_{out}"))
    rowed = pixels.select("*", *near)
    gaps = {out: f"_{out}" for out in targets}
    if bound is None:
        fields = [f for f in rowed.schema if f.name not in gaps.values()]
        schema = T.StructType(fields + [T.StructField(out, T.DoubleType()) for out in targets])
        # one task has all of a column: the repartition's own keys, and no later split of it
        done = rowed.repartition(*keys, "x").sortWithinPartitions(*keys, "x", "y").mapInArrow(
            column_pass([*keys, "x"], gaps), schema)
    else:
        col = _along_y(keys)
        square = lambda gap: F.least(*[
            _at(gap, dy, col) * _at(gap, dy, col) + dy * dy for dy in range(-bound, bound + 1)])
        found = {out: square(gap) for out, gap in gaps.items()} if bound else {out: F.col(gap) * F.col(gap) for out, gap in gaps.items()}
        done = rowed.select("*", *[c.alias(out) for out, c in found.items()]).withColumns(
            {out: F.when(F.col(out) <= bound * bound, F.sqrt(F.col(out).cast("double"))) for out in targets}).drop(*gaps.values())
    return (done.filter(only) if only else done).select(*pixels.columns, *targets)


def _any(flag: Column) -> Column:
    return flag.cast("int")


def halo_radius() -> Column:
    """Ring width grows with the image, so an upscaled copy measures the same."""
    return F.greatest(F.lit(2), F.rint(F.greatest("w", "h") / 512.0).cast("int"))


def halo_pct(pixels: DataFrame) -> DataFrame:
    """Pale, visible pixels in the ring just outside the opaque core, % of the ring.

    A kernel is fixed per ring width, one for each 512 pixels of side. The widths at hand are
    read first, so an image of any size finds its kernel.
    """
    radii = sorted(r[0] for r in pixels.select(halo_radius()).distinct().collect()) or [2]
    flagged = (
        pixels.withColumn("core", _any(F.col("a") >= 250))
        .withColumn("lum", luminance())
        .withColumn("core_lum", F.when(F.col("core") == 1, F.col("lum")).otherwise(0.0))
    )
    parts = None
    for r in radii:
        grown = morph(flagged.filter(halo_radius() == r), {
            "grown": ("core", ellipse(r), "max"), "near_core": ("core_lum", ellipse(r), "max"),
        })
        parts = grown if parts is None else parts.union(grown)
    return _halo_counts(parts)


def halo_flags() -> tuple[Column, Column]:
    """(ring, pale) conditions over ``core, grown, lum, near_core, a``."""
    ring = (F.col("grown") == 1) & (F.col("core") == 0)
    pale = (
        ring & (F.col("a") >= 32) & (F.col("a") < 255)
        & (F.col("lum") > 140) & (F.col("lum") < 250)
        & (F.col("lum") > F.col("near_core") + 25)
    )
    return ring, pale


def _halo_counts(grown: DataFrame) -> DataFrame:
    ring, pale = halo_flags()
    agg = grown.groupBy("image_id").agg(
        count_where(ring).alias("ring_px"), count_where(pale).alias("pale_px")
    )
    return agg.withColumn(
        "halo_pct",
        F.when(F.col("ring_px") == 0, 0.0).otherwise(F.col("pale_px") * 100.0 / F.col("ring_px")),
    )


def edge_contamination(pixels: DataFrame) -> DataFrame:
    """Semi-transparent, light and dark pixels in the band around solid content."""
    flagged = pixels.withColumn("solid", _any(F.col("a") >= dims.SOLID_ALPHA_MIN))
    kernel = ellipse(dims.EDGE_BAND_PX)
    grown = morph(flagged, {
        "outer": ("solid", kernel, "max"), "inner": ("solid", kernel, "min"),
    })
    return edge_counts(grown)


def edge_counts(grown: DataFrame) -> DataFrame:
    band = (F.col("outer") == 1) & (F.col("inner") == 0)
    seen = band & (F.col("a") > 0)
    counts = grown.groupBy("image_id").agg(
        count_where(band).alias("edge_pixel_count"),
        count_where(band & F.col("a").between(1, 254)).alias("edge_contamination_count"),
        count_where(seen & (F.least("r", "g", "b") >= dims.HALO_LIGHT_MIN)).alias("halo_white_px"),
        count_where(seen & (F.greatest("r", "g", "b") <= dims.HALO_DARK_MAX)).alias("halo_dark_px"),
    )
    pct = half_even(F.col("edge_contamination_count") * 100.0 / F.col("edge_pixel_count"), 2)
    return counts.withColumn(
        "edge_contamination_pct", F.when(F.col("edge_pixel_count") == 0, 0.0).otherwise(pct)
    )


def stray_pixels(pixels: DataFrame) -> DataFrame:
    """Faint pixels outside the grown solid content, and soft ones inside it."""
    flagged = pixels.withColumn("solid", _any(F.col("a") >= dims.SOLID_ALPHA_MIN))
    grown = morph(flagged, {"intent": ("solid", ellipse(dims.INTENT_DILATE_PX), "max")})
    return grown.groupBy("image_id").agg(
        count_where(F.col("a").between(1, dims.STRAY_ALPHA_MAX) & (F.col("intent") == 0))
        .alias("low_alpha_outside_intent_count"),
        count_where(F.col("a").between(1, 254) & (F.col("intent") == 1))
        .alias("semi_transparent_inside_effects_count"),
    )


def soft_edge_pct(pixels: DataFrame, level: str = "a",
                  side: int = dims.ANALYSIS_LONG_SIDE) -> DataFrame:
    """Share of the half-opaque contour whose transition is wider than 3 px."""
    lo, hi = dims.EDGE_ALPHA
    flagged = shrink(pixels, [level], side).select(
        "image_id", "w", "h", "x", "y",
        _any(F.col(level) >= 128).alias("inside"),
        (F.col(level) <= lo).alias("is_clear"), (F.col(level) >= hi).alias("is_opaque"),
    )
    edged = morph(flagged, {"eroded": ("inside", CROSS, "min")})
    boundary = (F.col("inside") == 1) & (F.col("eroded") == 0)
    edged = edged.select("image_id", "x", "y", "is_clear", "is_opaque", boundary.alias("boundary"))
    # a pixel counts with an opaque one within 16 px, and none clear that near makes its edge wide
    far = distance_to(edged, {"d_clear": "is_clear", "d_opaque": "is_opaque"}, only="boundary", bound=16)
    usable = F.col("d_opaque") <= 16
    soft = usable & (
        F.col("d_clear").isNull() | (F.col("d_clear") + F.col("d_opaque") - 1 > dims.EDGE_SOFT_PX)
    )
    counted = far.groupBy("image_id").agg(
        count_where(usable).alias("boundary_px"), count_where(soft).alias("soft_px")
    )
    every = pixels.select("image_id").distinct().join(counted, "image_id", "left")
    agg = every.select("image_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("boundary_px", "soft_px")])
    return agg.withColumn(
        "soft_edge_pct",
        F.when(F.col("boundary_px") == 0, 0.0).otherwise(F.col("soft_px") * 100.0 / F.col("boundary_px")),
    )


def with_pseudo_alpha(pixels: DataFrame) -> DataFrame:
    """Alpha-like level of an opaque image: distance from its border colour, scaled by
    the median distance inside the content."""
    from rasterqa.operators import masks

    bg = masks.background_colour(pixels, "ring")
    far = pixels.join(bg, "image_id").withColumn("dist", masks.background_distance())
    ref = far.groupBy("image_id").agg(
        F.percentile(F.when(F.col("content"), F.col("dist")), 0.5).alias("ref")
    )
    scaled = F.col("dist") / F.greatest(F.coalesce("ref", F.lit(0.0)), F.lit(1.0))
    return far.join(ref, "image_id").withColumn(
        "pseudo_a", F.least(F.lit(1.0), scaled) * 255.0
    ).drop("bg_r", "bg_g", "bg_b", "dist", "ref")


def gradient_pct(pixels: DataFrame, side: int = dims.ANALYSIS_LONG_SIDE) -> DataFrame:
    """Share of content with a gentle tonal change (3 < magnitude < 25)."""
    flat = pixels.withColumn("level", luminance()).withColumn(
        "inside", F.when(F.col("content"), 255).otherwise(0))
    copy = shrink(flat, ["level", "inside"], side)
    copy = copy.withColumn("level", level8(F.col("level"))).withColumn("content", F.rint("inside") > 127)
    graded = gradient(copy)
    return graded.groupBy("image_id").agg(gradient_share())


def gradient_share() -> Column:
    smooth = F.when((F.col("mag") > 3) & (F.col("mag") < 25), 1.0).otherwise(0.0)
    return F.coalesce(F.avg(F.when(F.col("content"), smooth)) * 100.0, F.lit(0.0)).alias("gradient_pct")


def min_line_width(pixels: DataFrame) -> DataFrame:
    """Twice the 5th percentile of the distance from content to non-content."""
    flagged = pixels.withColumn("outside", ~F.col("content"))
    far = distance_to(flagged.select("image_id", "x", "y", "content", "outside"), {"d": "outside"}, only="content")
    return far.groupBy("image_id").agg(
        (F.percentile("d", 0.05) * 2).alias("min_line_px")
    )


def min_feature(comps: DataFrame, dpi: Column) -> DataFrame:
    """10th percentile of component heights, noise and sub-millimetre specks dropped."""
    tall, wide = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    speck = F.lit(dims.FEATURE_SPECK_MM / 25.4) * dpi
    kept = comps.filter((tall >= 3) & (wide >= 3) & (F.col("area") >= 12)).filter(
        (tall >= speck) | (wide >= speck)
    )
    return kept.groupBy("image_id").agg(F.percentile(tall, 0.1).alias("min_feature_px"))


def image_dpi(pixels: DataFrame, dpi: int = dims.DEFAULT_DPI) -> DataFrame:
    """``image_id, dpi``: the pixels' own resolution where they carry one, else ``dpi``."""
    own = F.max("dpi") if "dpi" in pixels.columns else F.lit(None)
    return pixels.groupBy("image_id").agg(F.coalesce(own, F.lit(dpi)).cast("double").alias("dpi"))


def stroke_mask(copy: DataFrame, dpis: DataFrame, original: DataFrame) -> DataFrame:
    """Content without specks under half a millimetre square (kept if all are specks).

    ``copy`` may be a shrunken raster of ``original``; the speck size shrinks with it.
    """
    labelled = cc.label_runs(copy.filter("content").select("image_id", "x", "y"), 8)
    full = original.groupBy("image_id").agg(F.max(F.greatest("w", "h")).alias("longest"))
    now = copy.groupBy("image_id").agg(F.max(F.greatest("w", "h")).alias("side"))
    scale = full.join(now, "image_id").select(
        "image_id", F.least(F.lit(1.0), F.col("side") / F.col("longest")).alias("scale"))
    side_px = F.lit(dims.STROKE_MIN_COMP_MM / 25.4) * F.col("dpi") * F.col("scale")
    sized = cc.component_stats(labelled).join(scale, "image_id").join(dpis, "image_id")
    big = sized.filter(F.col("area") >= F.greatest(F.lit(4.0), side_px * side_px)).select("image_id", "comp_id")
    any_big = big.select("image_id").distinct().withColumn("has_big", F.lit(True))
    kept = (
        labelled.join(big.withColumn("big", F.lit(True)), ["image_id", "comp_id"], "left")
        .join(any_big, "image_id", "left")
        .filter("big or has_big is null")
    )
    marks = cc.component_pixels(kept).select("image_id", "x", "y", F.lit(True).alias("stroke"))
    return (
        copy.select("image_id", "w", "h", "x", "y")
        .join(marks, ["image_id", "x", "y"], "left")
        .withColumn("stroke", F.coalesce("stroke", F.lit(False)))
    )


def min_stroke(pixels: DataFrame, dpis: DataFrame | None = None,
               side: int = dims.STROKE_LONG_SIDE) -> DataFrame:
    """Thinnest stroke in px: 5th percentile of 2·thickness−1 along the skeleton.

    Thickness of a pixel is the largest disc inside the shape that covers it. Distances come from
    ``distance_to``; the content pixels of an analysis copy, ``side`` squared at most, then go to one
    task, which looks at skeleton pixels only.
    """
    inside = pixels.withColumn("inside", F.when(F.col("content"), 255).otherwise(0))
    copy = shrink(inside, ["inside"], side).withColumn("content", F.rint("inside") > 127)
    dpis = image_dpi(pixels) if dpis is None else dpis
    mask = stroke_mask(copy, dpis, pixels).withColumn("outside", ~F.col("stroke"))
    far = distance_to(mask, {"d": "outside"}, only="stroke").select(
        "image_id", "x", "y", F.coalesce("d", F.greatest("w", "h").cast("double")).alias("d"))
    schema = T.StructType([mask.schema["image_id"], T.StructField("thin", T.DoubleType())])
    # a number of partitions that small copies don't shrink: the work is in the tasks, not in the rows
    dealt = far.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    thin = dealt.sortWithinPartitions("image_id").mapInArrow(stroke_of_copies(side), schema)
    full = pixels.groupBy("image_id").agg(F.max(F.greatest("w", "h")).alias("longest"))
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.col("longest"))
    return thin.join(full, "image_id").select(
        "image_id", F.greatest(F.col("thin") / scale, F.lit(1.0)).alias("min_stroke_px"))


def resample(pixels: DataFrame, values: list[str], out_w: Column, out_h: Column,
             keys: Keys = IMAGE) -> DataFrame:
    """Area-weighted resize of dense columns to ``out_w x out_h``.

    A source pixel is sent to the target cells it overlaps (four at most when
    shrinking); sums combine before the shuffle.
    """
    def cells(pos: str, size: str, out: str) -> Column:
        lo = F.floor(F.col(pos) * F.col(out) / F.col(size)).cast("int")
        hi = (F.ceil((F.col(pos) + 1) * F.col(out) / F.col(size)) - 1).cast("int")
        return F.sequence(lo, F.greatest(lo, hi))

    def overlap(pos: str, size: str, out: str, cell: str) -> Column:
        """Shared length in units of 1/(source·target) of the axis, an exact integer."""
        start = F.greatest(F.col(pos) * F.col(out), F.col(cell) * F.col(size))
        end = F.least((F.col(pos) + 1) * F.col(out), (F.col(cell) + 1) * F.col(size))
        return (end - start).cast("bigint")

    sized = pixels.withColumn("ow", out_w.cast("int")).withColumn("oh", out_h.cast("int"))
    wide = sized.select("*", F.explode(cells("x", "w", "ow")).alias("tx"))
    wide = wide.select("*", F.explode(cells("y", "h", "oh")).alias("ty"))
    weight = overlap("x", "w", "ow", "tx") * overlap("y", "h", "oh", "ty")
    weighed = wide.withColumn("wt", weight).filter("wt > 0")
    return weighed.groupBy(*keys, "ow", "oh", "tx", "ty").agg(
        *[(F.sum(F.col(v) * F.col("wt")) / F.sum("wt")).alias(v) for v in values]
    ).withColumnsRenamed({"ow": "w", "oh": "h", "tx": "x", "ty": "y"})


def shrink(pixels: DataFrame, values: list[str], side: int) -> DataFrame:
    """Copies with the long side capped at ``side``; smaller rasters pass unchanged."""
    longest = F.greatest("w", "h")
    cols = ["image_id", "w", "h", "x", "y", *values]
    scaled = lambda c: F.greatest(F.lit(1.0), F.rint(F.col(c) * F.lit(float(side)) / longest))
    big = pixels.filter(longest > side)
    cut_down = resample(big, values, scaled("w"), scaled("h"))
    kept = pixels.filter(longest <= side).select(
        *cols[:5], *[F.col(v).cast("double").alias(v) for v in values])
    return kept.unionByName(cut_down.select(*cols))


def resample_nearest(pixels: DataFrame, values: list[str], out_w: Column, out_h: Column,
                     keys: Keys = IMAGE) -> DataFrame:
    """Nearest resize: target cell ``t`` reads source ``floor(t·size/out)``. No shuffle."""
    def cells(pos: str, size: str, out: str) -> Column:
        lo = F.ceil(F.col(pos) * F.col(out) / F.col(size)).cast("int")
        hi = (F.ceil((F.col(pos) + 1) * F.col(out) / F.col(size)) - 1).cast("int")
        return F.when(hi >= lo, F.sequence(lo, F.greatest(lo, hi)))

    sized = pixels.withColumn("ow", out_w.cast("int")).withColumn("oh", out_h.cast("int"))
    wide = sized.select("*", F.explode(cells("x", "w", "ow")).alias("tx"))
    wide = wide.select("*", F.explode(cells("y", "h", "oh")).alias("ty"))
    return wide.select(
        *keys, F.col("ow").alias("w"), F.col("oh").alias("h"),
        F.col("tx").alias("x"), F.col("ty").alias("y"), *values,
    )


def edge_map(pixels: DataFrame, src: str, low: float, high: float,
             keys: Keys = IMAGE) -> DataFrame:
    """Canny edges of an 8-bit level column: boolean ``edge``.

    Gradient magnitude is |gx|+|gy|; ridge pixels survive along the gradient's sector;
    weak ridges stay only in an 8-connected component that holds a strong one.
    """
    graded = separable(pixels, {"gx": (src, DIFF, SMOOTH), "gy": (src, SMOOTH, DIFF)}, keys)
    graded = graded.withColumn("m", F.abs("gx") + F.abs("gy"))
    row, col = _along_x(keys), _along_y(keys)
    lateral = graded.select("*", F.coalesce(_at("m", -1, row), F.lit(0.0)).alias("ml"),
                            F.coalesce(_at("m", 1, row), F.lit(0.0)).alias("mr"))
    near = lateral.select(
        "*", *[F.coalesce(_at(c, d, col), F.lit(0.0)).alias(f"{c}_{n}")
               for c in ("m", "ml", "mr") for d, n in ((-1, "up"), (1, "dn"))]
    )
    tan22, tan67 = math.tan(math.pi / 8), math.tan(3 * math.pi / 8)
    ax, ay = F.abs("gx"), F.abs("gy")
    flat = ay < ax * tan22
    steep = ay > ax * tan67
    same = (F.col("gx") < 0) == (F.col("gy") < 0)
    ridge = (
        F.when(flat, (F.col("m") > F.col("ml")) & (F.col("m") >= F.col("mr")))
        .when(steep, (F.col("m") > F.col("m_up")) & (F.col("m") >= F.col("m_dn")))
        .when(same, (F.col("m") > F.col("ml_up")) & (F.col("m") > F.col("mr_dn")))
        .otherwise((F.col("m") > F.col("mr_up")) & (F.col("m") > F.col("ml_dn")))
    )
    weak = near.filter(ridge & (F.col("m") > low)).select(
        *keys, "x", "y", (F.col("m") > high).alias("strong")
    )
    weak = cut_lineage(weak)
    labelled = cc.label_runs(weak.select(*keys, "x", "y"), 8, keys)
    member = cc.component_pixels(labelled, keys)
    alive = (
        member.join(weak.filter("strong").select(*keys, "x", "y"), [*keys, "x", "y"], "left_semi")
        .select(*keys, "comp_id").distinct()
    )
    kept = member.join(alive, [*keys, "comp_id"], "left_semi").select(
        *keys, "x", "y", F.lit(True).alias("edge"))
    return pixels.join(kept, [*keys, "x", "y"], "left").withColumn(
        "edge", F.coalesce("edge", F.lit(False)))
