"""Before / after geometry blocks, their comparison and PASS-WARN-FAIL verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa import dims, schemas
from rasterqa.functions.numbers import half_even, orientation
from rasterqa.operators import components as cc, kernels, masks, metrics

T = dims.GEOMETRY_THRESHOLDS


def weighted_mean_nulls(values: list[Column], weights: list[float], lo=0.0, hi=100.0) -> Column:
    """Weighted mean over the values present; NULL parts drop out of both sums."""
    clamp = lambda v: F.greatest(F.lit(lo), F.least(F.lit(hi), v))
    num = sum((F.when(v.isNotNull(), clamp(v) * w).otherwise(0.0) for v, w in zip(values, weights)), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(values, weights)), F.lit(0.0))
    return F.when(den > 0, num / den)


def status_low(value: Column, warn: float, fail: float) -> Column:
    return F.when(value.isNull(), "N/A").when(value < fail, "FAIL").when(value < warn, "WARN").otherwise("PASS")


def worst_status(*statuses: Column) -> Column:
    """Worst of the real statuses; N/A only if none is real."""
    rank = lambda s: F.when(s == "FAIL", 2).when(s == "WARN", 1).when(s == "PASS", 0)
    top = F.greatest(*[rank(s) for s in statuses]) if len(statuses) > 1 else rank(statuses[0])
    return F.coalesce(F.get(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), top), F.lit("N/A"))


def normalised_box(x: str, y: str, bw: str, bh: str, w: str, h: str) -> dict[str, Column]:
    return {
        "x0": F.col(x) / F.col(w), "y0": F.col(y) / F.col(h),
        "x1": (F.col(x) + F.col(bw)) / F.col(w), "y1": (F.col(y) + F.col(bh)) / F.col(h)}


def bbox_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    zero = F.lit(0.0)
    side = lambda lo, hi, p, q: F.greatest(zero, F.least(p[hi], q[hi]) - F.greatest(p[lo], q[lo]))
    inter = side("x0", "x1", a, b) * side("y0", "y1", a, b)
    area = lambda p: F.greatest(zero, p["x1"] - p["x0"]) * F.greatest(zero, p["y1"] - p["y0"])
    union = area(a) + area(b) - inter
    present = a["x0"].isNotNull() & b["x0"].isNotNull()
    return F.when(present, F.when(union > 0, inter / union).otherwise(0.0))


def mask_iou(frames: DataFrame) -> DataFrame:
    """Overlap of two masks on one grid ``(pair_id, on_o, on_g)``."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    o, g = F.col("on_o"), F.col("on_g")
    agg = frames.groupBy("pair_id").agg(count(o & g).alias("inter"), count(o | g).alias("union"))
    return agg.select("pair_id", F.when(F.col("union") > 0, F.col("inter") / F.col("union")).otherwise(0.0).alias("mask_iou"))


def position_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    mid = lambda p, lo, hi: (p[lo] + p[hi]) / 2.0
    dx, dy = mid(b, "x0", "x1") - mid(a, "x0", "x1"), mid(b, "y0", "y1") - mid(a, "y0", "y1")
    return (1.0 - F.sqrt(dx * dx + dy * dy) / math.sqrt(2)) * 100.0


def scale_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    area = lambda p: (p["x1"] - p["x0"]) * (p["y1"] - p["y0"])
    sa, sb = area(a), area(b)
    return F.when((sa > 0) & (sb > 0), F.least(sa, sb) / F.greatest(sa, sb) * 100.0)


def given(name: str, default=None) -> Column:
    """An operator's entry; blank text counts as not given."""
    value = F.when(F.trim(F.col(name)) != "", F.col(name))
    return value if default is None else F.coalesce(value, F.lit(str(default)))


def measure_before(pixels: DataFrame, inputs: DataFrame, profile_id: str = "DTF_STANDARD_V1",
                   template_version: str = "GEOMETRY_GENERATE_V1") -> DataFrame:
    """BEFORE block of every source image, one column per declared field.

    ``inputs(image_id, source_filename, <operator entries as text>)``. Fields that need
    vision stay NULL.
    """
    d = dims.GEOMETRY_DEFAULTS
    masked = masks.content_mask(pixels, "geometry")
    box = metrics.bbox(masked)
    kind = masks.background_type(pixels).select("image_id", "real_alpha", "background_type")
    comps = cc.components(masked.filter("content").select("image_id", "x", "y"), 8)
    objects = comps.groupBy("image_id").agg(
        F.sum(F.when(F.col("area") >= dims.COMPONENT_MIN_AREA, 1).otherwise(0)).cast("bigint").alias("object_count"))
    joined = box.join(kind, "image_id").join(objects, "image_id", "left").join(inputs, "image_id")
    width_in = given("target_print_width_in", d["target_print_width_in"]).cast("double")
    dpi = given("target_dpi", d["target_dpi"]).cast("int")
    mode = given("reconstruction_mode", d["reconstruction_mode"])
    placed = metrics.layout_metrics(metrics.target_geometry(joined, width_in, dpi))
    free = F.upper(mode) != "EXACT_RECONSTRUCTION"
    fields: dict[str, Column] = {
        "artwork_id": F.col("image_id").cast("string"), "source_filename": F.col("source_filename"),
        "source_width_px": F.col("w"), "source_height_px": F.col("h"),
        "source_aspect_ratio": F.col("aspect_ratio"), "source_orientation": F.col("orientation"),
        "source_has_alpha": F.col("real_alpha"), "source_background_type": F.col("background_type"),
        "source_bbox_x": F.col("bx"), "source_bbox_y": F.col("by"),
        "source_bbox_width": F.col("bw"), "source_bbox_height": F.col("bh"),
        "source_padding_left": F.col("pad_left"), "source_padding_right": F.col("pad_right"),
        "source_padding_top": F.col("pad_top"), "source_padding_bottom": F.col("pad_bottom"),
        "source_center_x_pct": F.col("center_x_pct"), "source_center_y_pct": F.col("center_y_pct"),
        "reconstruction_mode": mode, "print_method": F.lit(dims.PRINT_METHOD),
        "print_location": given("print_location", d["print_location"]),
        "garment_style": F.trim(given("garment_style")), "garment_color": F.trim(given("garment_color")),
        "target_print_width_in": F.col("target_width_in"), "target_print_height_in": F.col("target_height_in"),
        "target_dpi": dpi, "target_width_px": F.col("target_width_px"),
        "target_height_px": F.col("target_height_px"), "target_aspect_ratio": F.col("target_aspect_ratio"),
        "aspect_ratio_policy": given("aspect_ratio_policy", d["aspect_ratio_policy"]),
        "max_ratio_variance_pct": F.lit(dims.MAX_RATIO_VARIANCE_PCT),
        "crop_allowed": free, "stretch_allowed": free, "reposition_allowed": free,
        "background_requirement": given("background_requirement", d["background_requirement"]),
        "max_transparent_margin_in": F.lit(dims.MAX_TRANSPARENT_MARGIN_IN),
        "white_elements_policy": F.trim(given("white_elements_policy")),
        "black_elements_policy": F.trim(given("black_elements_policy")),
        "semi_transparency_allowed": given("semi_transparency_allowed"),
        "distress_policy": given("distress_policy", d["distress_policy"]),
        "text_must_match_exactly": ~free, "object_count": F.coalesce("object_count", F.when(F.col("real_alpha"), 0)),
        "generation_prompt_version": F.lit(template_version), "dtf_profile_id": F.lit(profile_id),
    }
    return placed.select("image_id", *[
        fields.get(name, F.lit(None).cast("string")).alias(name) for name in schemas.BEFORE_FIELDS])


def measure_after(pixels: DataFrame, before: DataFrame, pairs: DataFrame) -> DataFrame:
    """AFTER block of every output image against its source's BEFORE block.

    ``pairs(pair_id, original_id, generated_id)``. Pixel work is per output image; the
    comparison itself is arithmetic on two joined rows.
    """
    masked = masks.content_mask(pixels, "geometry")
    box = metrics.bbox(masked)
    real = pixels.groupBy("image_id").agg(F.bool_or(F.col("a") < 255).alias("real_alpha"))
    hist = metrics.alpha_histogram(pixels)
    stray = kernels.stray_pixels(pixels)
    edge = kernels.edge_contamination(pixels)
    objects = cc.objects_summary(
        cc.components(masked.filter("content").select("image_id", "x", "y"), 8),
        dims.COMPONENT_MIN_AREA, dims.ISOLATED_COMPONENT_AREA, dims.MICRO_COMPONENT_AREA)
    line = kernels.min_line_width(masked)
    hole = cc.min_hole(masked)
    out = box
    for part in (real, hist, stray, edge):
        out = out.join(part, "image_id")
    for part in (objects, line, hole):
        out = out.join(part, "image_id", "left")
    outputs = out.withColumnRenamed("image_id", "generated_id")
    sources = before.withColumnRenamed("image_id", "original_id")
    joined = pairs.join(sources, "original_id").join(outputs, "generated_id")
    return joined.select("pair_id", "original_id", "generated_id", *_after_fields(joined)).transform(_verdicts)


def _after_fields(joined: DataFrame) -> list[Column]:
    src = normalised_box("source_bbox_x", "source_bbox_y", "source_bbox_width", "source_bbox_height",
                         "source_width_px", "source_height_px")
    dst = normalised_box("bx", "by", "bw", "bh", "w", "h")
    right, bottom = F.col("w") - (F.col("bx") + F.col("bw")), F.col("h") - (F.col("by") + F.col("bh"))
    dpi = F.coalesce("target_dpi", F.lit(dims.GEOMETRY_DEFAULTS["target_dpi"]))
    aspect = half_even(F.col("w") / F.col("h"), 4)
    only_alpha = lambda c: F.when(F.col("real_alpha"), F.col(c))
    ratio_diff = half_even(
        F.abs(aspect - F.col("source_aspect_ratio")) / F.col("source_aspect_ratio") * 100.0, 2)
    iou = half_even(bbox_iou(src, dst) * 100.0, 2)
    position = half_even(position_similarity(src, dst), 2)
    scale = half_even(scale_similarity(src, dst), 2)
    weights = list(dims.GEOMETRY_WEIGHTS.values())
    overall = half_even(weighted_mean_nulls([iou, position, scale, 100.0 - ratio_diff], weights), 2)
    any_content = F.col("n_content") > 0
    fields: dict[str, Column] = {
        "output_width_px": F.col("w"), "output_height_px": F.col("h"), "output_aspect_ratio": aspect,
        "output_orientation": orientation(F.col("w"), F.col("h")), "output_has_alpha": F.col("real_alpha"),
        "effective_dpi_x": half_even(F.try_divide("w", "target_print_width_in"), 1),
        "effective_dpi_y": half_even(F.try_divide("h", "target_print_height_in"), 1),
        "output_bbox_x": F.col("bx"), "output_bbox_y": F.col("by"),
        "output_bbox_width": F.col("bw"), "output_bbox_height": F.col("bh"),
        "padding_left": F.col("bx"), "padding_right": right, "padding_top": F.col("by"), "padding_bottom": bottom,
        "padding_left_in": half_even(F.col("bx") / dpi, 3), "padding_right_in": half_even(right / dpi, 3),
        "padding_top_in": half_even(F.col("by") / dpi, 3), "padding_bottom_in": half_even(bottom / dpi, 3),
        "output_center_x_pct": half_even((F.col("bx") + F.col("bw") / 2.0) * 100.0 / F.col("w"), 2),
        "output_center_y_pct": half_even((F.col("by") + F.col("bh") / 2.0) * 100.0 / F.col("h"), 2),
        "alpha_zero_count": only_alpha("alpha_0"),
        **{f"alpha_{n}_count": only_alpha(f"alpha_{n}") for n, _, _ in metrics.ALPHA_BUCKETS[1:]},
        "low_alpha_outside_intent_count": only_alpha("low_alpha_outside_intent_count"),
        "semi_transparent_inside_effects_count": only_alpha("semi_transparent_inside_effects_count"),
        "edge_pixel_count": only_alpha("edge_pixel_count"),
        "edge_contamination_count": only_alpha("edge_contamination_count"),
        "edge_contamination_pct": only_alpha("edge_contamination_pct"),
        "halo_white_px": only_alpha("halo_white_px"), "halo_dark_px": only_alpha("halo_dark_px"),
        "fringe_pixel_count": only_alpha("edge_contamination_count"),
        "connected_component_count": F.coalesce("n_components", F.when(F.col("real_alpha"), 0)),
        "isolated_component_count": F.coalesce("n_isolated", F.when(F.col("real_alpha"), 0)),
        "micro_component_count": F.coalesce("n_micro", F.when(F.col("real_alpha"), 0)),
        "smallest_component_area_px": F.col("smallest_area"),
        "minimum_line_width_px": half_even(F.col("min_line_px"), 2),
        "minimum_line_width_in": half_even(F.col("min_line_px") / dpi, 4),
        "minimum_hole_size_px": F.when(any_content | F.col("real_alpha"), F.col("min_hole_px")),
        "distance_left_edge_px": F.col("bx"), "distance_right_edge_px": right,
        "distance_top_edge_px": F.col("by"), "distance_bottom_edge_px": bottom,
        "clipping_detected": F.when(any_content, F.least("bx", "by", right, bottom) <= 0),
        "source_ratio_difference_pct": ratio_diff, "bbox_similarity_pct": iou,
        "object_position_similarity_pct": position, "object_scale_similarity_pct": scale,
        "overall_geometry_similarity_pct": overall,
    }
    carried = [F.col(c) for c in ("background_requirement", "target_dpi", "target_print_width_in",
                                  "target_print_height_in")]
    measured = [n for n in schemas.AFTER_FIELDS if not n.endswith("_status")]
    return carried + [fields.get(n, F.lit(None).cast("double")).alias(n) for n in measured]


def background_status(requirement: Column, has_alpha: Column) -> Column:
    req = F.lower(F.trim(requirement))
    return (
        F.when(req == "transparent", F.when(has_alpha, "PASS").otherwise("FAIL"))
        .when(F.coalesce(req, F.lit("")) != "", "PASS").otherwise("N/A"))


def stray_status(stray: Column, has_alpha: Column) -> Column:
    return (
        F.when(~has_alpha, "N/A").when(stray == 0, "PASS")
        .when(stray < dims.STRAY_FAIL_COUNT, "WARN").otherwise("FAIL"))


def halo_status(pct: Column, has_alpha: Column) -> Column:
    warn, fail = T["edge_contamination_pct"]
    value = F.coalesce(pct, F.lit(0.0))
    return F.when(~has_alpha, "N/A").when(value >= fail, "FAIL").when(value >= warn, "WARN").otherwise("PASS")


def clipping_status(clipped: Column) -> Column:
    return F.when(clipped.isNull(), "N/A").when(clipped, "FAIL").otherwise("PASS")


def _verdicts(after: DataFrame) -> DataFrame:
    alpha, stray = F.col("output_has_alpha"), F.col("low_alpha_outside_intent_count")
    verdicts = {
        "background_transparency_status": background_status(F.col("background_requirement"), alpha),
        "resolution_status": status_low(F.col("effective_dpi_x") / F.col("target_dpi"), *T["dpi_fraction"]),
        "geometry_status": status_low(F.col("overall_geometry_similarity_pct"), *T["geometry_similarity_pct"]),
        "alpha_status": stray_status(stray, alpha), "stray_pixel_status": stray_status(stray, alpha),
        "halo_status": halo_status(F.col("edge_contamination_pct"), alpha),
        "fine_detail_status": status_low(F.col("minimum_line_width_px"), *T["minimum_line_width_px"]),
        "clipping_status": clipping_status(F.col("clipping_detected")),
        "text_status": F.lit("N/A"), "semantic_status": F.lit("N/A"),
    }
    judged = after.select("*", *[v.alias(n) for n, v in verdicts.items()])
    real = [F.col(n) for n in verdicts if n not in ("text_status", "semantic_status")]
    whole = judged.withColumn("overall_qa_status", worst_status(*real))
    kept = ["pair_id", "original_id", "generated_id", "target_print_width_in", "target_print_height_in"]
    return whole.select(*kept, *schemas.AFTER_FIELDS)


def approval(outputs: DataFrame) -> DataFrame:
    """Approval block: content hash and print size known, the rest NULL."""
    known = {
        "approved_file_hash": F.sha2(F.col("content"), 256),
        "approved_print_width_in": F.col("target_print_width_in"),
        "approved_print_height_in": F.col("target_print_height_in"),
    }
    return outputs.select("pair_id", *[
        known.get(n, F.lit(None).cast("string")).alias(n) for n in schemas.APPROVAL_FIELDS])


def master_json(before: DataFrame, after: DataFrame, approvals: DataFrame) -> DataFrame:
    """One JSON document per artwork: before, after, autofix, approval, NULLs kept."""
    pack = lambda df, key, fields, name: df.select(key, F.struct(*fields).alias(name))
    blocks = pack(after, "pair_id", schemas.AFTER_FIELDS, "after").join(
        after.select("pair_id", "original_id"), "pair_id")
    joined = blocks.join(
        pack(before, "image_id", schemas.BEFORE_FIELDS, "before").withColumnRenamed("image_id", "original_id"),
        "original_id").join(pack(approvals, "pair_id", schemas.APPROVAL_FIELDS, "approval"), "pair_id")
    autofix = F.struct(*[F.lit(None).cast("string").alias(n) for n in schemas.AUTOFIX_FIELDS])
    doc = F.struct(
        F.col("original_id").cast("string").alias("artwork_id"), "before", "after",
        autofix.alias("autofix"), "approval")
    return joined.select("pair_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("master"))
