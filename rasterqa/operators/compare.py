"""Pair comparison: hashes, shape, colour, edges, structure and the blended score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa import dims
from rasterqa.functions.numbers import clamp01, half_even, luminance
from rasterqa.operators import colour, components as cc, dct, kernels, masks, metrics, stacks, transforms
from rasterqa.session import cut_lineage


def phash64(pixels: DataFrame) -> DataFrame:
    """Perceptual hash bits as a string and as 64-bit words: 32x32 grey, 8x8 low block, median without its first row."""
    return dct.hashes(pixels.withColumn("grey", half_even(luminance())), "grey", 32, 8, True, ("image_id",))


def phash256(grey: DataFrame, level: str = "grey", keys=("image_id",)) -> DataFrame:
    """64x64 grey, 16x16 low block, plain median."""
    return dct.hashes(grey, level, 64, 16, False, keys)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two word arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, n: acc + n)


def hash_similarity(a: Column, b: Column, bits: int) -> Column:
    return (1 - hamming(a, b) / bits) * 100.0


def image_features(pixels: DataFrame) -> DataFrame:
    """Per image: size, alpha, box, shape, contours, dominant and mean colours."""
    masked = transforms.content_mask_connected(pixels)
    stats = metrics.alpha_colour_stats(masked)
    box = metrics.bbox(masked)
    shape = metrics.shape_features(masked).drop("n_content", "aspect", "box_area")
    contours = metrics.contour_features(cc.nesting(masked))
    dominant = colour.dominant_colours(masked).groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "r", "g", "b", "share"))).alias("dominant"))
    alpha = pixels.groupBy("image_id").agg(F.bool_or(F.col("a") < 255).alias("has_alpha"))
    out = box.join(stats, "image_id").join(shape, "image_id").join(alpha, "image_id")
    out = out.join(contours, "image_id", "left").join(dominant, "image_id", "left")
    return out.select(
        "image_id", "w", "h", "has_alpha", "mean_r", "mean_g", "mean_b", "transparent_pct",
        F.coalesce(F.col("bw") / F.col("bh"), F.lit(1.0) * F.col("w") / F.col("h")).alias("box_aspect"),
        "fill", "cx", "cy", F.coalesce("n_contours", F.lit(0)).alias("n_contours"),
        F.coalesce("largest_contour_share", F.lit(0.0)).alias("largest_contour_share"), "dominant",
    )


def pair_up(pairs: DataFrame, per_image: DataFrame) -> DataFrame:
    """Join both sides' columns onto ``pairs``, prefixed ``o_`` and ``g_``."""
    side = lambda p, key: per_image.select(*[
        F.col(c).alias(key if c == "image_id" else p + c) for c in per_image.columns])
    return pairs.join(side("o_", "original_id"), "original_id").join(side("g_", "generated_id"), "generated_id")


def shape_similarity() -> Column:
    """Blend of box aspect, fill, centroid and contour count, 0..100."""
    oa, ga = F.col("o_box_aspect"), F.col("g_box_aspect")
    aspect = F.when((oa <= 0) | (ga <= 0), 0.0).otherwise(
        1 - F.least(F.lit(1.0), F.abs(oa - ga) / F.greatest(oa, ga)))
    fill = 1 - F.least(F.lit(1.0), F.abs(F.col("o_fill") - F.col("g_fill")))
    drift = F.sqrt(F.pow(F.col("o_cx") - F.col("g_cx"), 2) + F.pow(F.col("o_cy") - F.col("g_cy"), 2))
    centre = 1 - F.least(F.lit(1.0), drift / 0.5)
    on, gn = F.col("o_n_contours"), F.col("g_n_contours")
    contours = F.when((on == 0) & (gn == 0), 1.0).otherwise(
        1 - F.least(F.lit(1.0), F.abs(on - gn) / F.greatest(on, gn, F.lit(1))))
    return half_even(clamp01(0.35 * aspect + 0.30 * fill + 0.20 * centre + 0.15 * contours) * 100).cast("int")


def colour_matches() -> Column:
    """Dominant colours of the original with a near one (each channel) in the result."""
    near = lambda p: F.exists("g_dominant", lambda q: (
        (F.abs(p["r"] - q["r"]) <= dims.COLOUR_TOLERANCE) & (F.abs(p["g"] - q["g"]) <= dims.COLOUR_TOLERANCE)
        & (F.abs(p["b"] - q["b"]) <= dims.COLOUR_TOLERANCE)))
    return F.coalesce(F.size(F.filter("o_dominant", near)), F.lit(0))


def colour_similarity() -> Column:
    """Share of matched dominant colours and closeness of the mean colours, 0..100."""
    overlap = F.when(
        (F.size("o_dominant") > 0) & (F.size("g_dominant") > 0), colour_matches() / F.size("o_dominant")).otherwise(0.0)
    d2 = [F.pow(F.col(f"o_mean_{c}") - F.col(f"g_mean_{c}"), 2) for c in "rgb"]
    mean = 1 - F.least(F.lit(1.0), F.sqrt(d2[0] + d2[1] + d2[2]) / dims.MAX_RGB_DISTANCE)
    return half_even(clamp01(0.6 * F.coalesce(overlap, F.lit(0.0)) + 0.4 * mean) * 100).cast("int")


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def edge_f1(frames: DataFrame) -> DataFrame:
    """Edge agreement per pair within 3 px, over frames holding both sides' edges
    ``(pair_id, w, h, x, y, edge_o, edge_g)``."""
    far = kernels.distance_to(frames, {"to_o": "edge_o", "to_g": "edge_g"}, keys=("pair_id",), bound=dims.EDGE_TOLERANCE_PX)
    near = lambda edge, dist: F.sum(F.when(F.col(edge) & (F.col(dist) <= dims.EDGE_TOLERANCE_PX), 1).otherwise(0))
    total = lambda edge: F.sum(F.when(F.col(edge), 1).otherwise(0))
    agg = far.groupBy("pair_id").agg(
        total("edge_o").alias("n_o"), total("edge_g").alias("n_g"),
        near("edge_o", "to_g").alias("hit_o"), near("edge_g", "to_o").alias("hit_g"))
    score = f1(F.col("hit_o") / F.col("n_o"), F.col("hit_g") / F.col("n_g"))
    return agg.select(
        "pair_id", "n_o", "n_g",
        F.when((F.col("n_o") == 0) & (F.col("n_g") == 0), 1.0)
        .when((F.col("n_o") == 0) | (F.col("n_g") == 0), 0.0).otherwise(score).alias("edge_f1"))


SSIM_TAPS = kernels.gaussian_taps(11, 1.5)


def ssim(frames: DataFrame) -> DataFrame:
    """Mean SSIM per pair over the grown union of contents, clamped to 0..1.

    ``frames(pair_id, w, h, x, y, grey_o, grey_g, region)`` with ``region`` 0/1; the five
    local moments are blurred together in one pair of passes.
    """
    o, g = F.col("grey_o"), F.col("grey_g")
    products = frames.select("*", (o * o).alias("oo"), (g * g).alias("gg"), (o * g).alias("og"))
    keys = ("pair_id",)
    blurred = kernels.separable(products, {
        f"m_{c}": (c, SSIM_TAPS, SSIM_TAPS) for c in ("grey_o", "grey_g", "oo", "gg", "og")}, keys)
    grown = kernels.morph(blurred, {"near": ("region", kernels.box(4), "max")}, keys)
    mo, mg = F.col("m_grey_o"), F.col("m_grey_g")
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    var_o, var_g = F.col("m_oo") - mo * mo, F.col("m_gg") - mg * mg
    cov = F.col("m_og") - mo * mg
    local = ((2 * mo * mg + c1) * (2 * cov + c2)) / ((mo * mo + mg * mg + c1) * (var_o + var_g + c2))
    return grown.groupBy("pair_id").agg(
        clamp01(F.coalesce(F.avg(F.when(F.col("near") == 1, local)), F.avg(local))).alias("ssim"))


def prepare_pairs(pairs: DataFrame, sizes: DataFrame, max_px: int = dims.COMPARE_MAX_PX) -> DataFrame:
    """Canvas plan per pair: pad the original to the result's ratio, cap both sides."""
    both = pair_up(pairs, sizes.select("image_id", "w", "h"))
    ratio = F.col("g_w") / F.col("g_h")
    padded = F.abs(F.col("o_w") / F.col("o_h") - ratio) > 1e-3
    new_w, new_h = transforms.padded_size(F.col("o_w"), F.col("o_h"), ratio)
    sized = both.select(
        *pairs.columns, padded.alias("padded"),
        F.when(padded, new_w).otherwise(F.col("o_w")).alias("ow"),
        F.when(padded, new_h).otherwise(F.col("o_h")).alias("oh"),
        F.col("g_w").alias("gw"), F.col("g_h").alias("gh"))
    cap = lambda c, a, b: F.when(F.greatest(a, b) > max_px, F.greatest(
        F.lit(1.0), F.rint(F.col(c) * F.lit(float(max_px)) / F.greatest(a, b)))).otherwise(F.col(c)).cast("int").alias(c)
    return sized.select(
        *pairs.columns, "padded", cap("ow", "ow", "oh"), cap("oh", "ow", "oh"),
        cap("gw", "gw", "gh"), cap("gh", "gw", "gh"))


def common_frames(pairs: DataFrame, views: DataFrame) -> DataFrame:
    """Both grey views of each pair on the original's frame, the result fitted and
    centred with neutral grey around it."""
    size = views.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    plan = pair_up(pairs, size)
    scale = F.least(F.col("o_w") / F.col("g_w"), F.col("o_h") / F.col("g_h"))
    same = (F.col("o_w") == F.col("g_w")) & (F.col("o_h") == F.col("g_h"))
    fit = lambda c: F.when(same, F.col(c)).otherwise(
        F.greatest(F.lit(1), F.rint(F.col(c) * scale).cast("int"))).cast("int")
    plan = plan.select("pair_id", "original_id", "generated_id", "o_w", "o_h",
                       fit("g_w").alias("fw"), fit("g_h").alias("fh"))
    left = views.withColumnRenamed("image_id", "original_id").join(plan, "original_id").select(
        "pair_id", "w", "h", "x", "y", F.col("grey").alias("grey_o"), F.col("content").alias("c_o"))
    source = views.withColumnRenamed("image_id", "generated_id").join(plan, "generated_id").select(
        F.col("pair_id").alias("image_id"), "w", "h", "x", "y", "grey", "content", "o_w", "o_h", "fw", "fh")
    fitted = transforms.fit_view(source, F.col("fw"), F.col("fh")).join(
        plan.select(F.col("pair_id").alias("image_id"), "o_w", "o_h"), "image_id")
    right = fitted.select(
        F.col("image_id").alias("pair_id"),
        (F.col("x") + F.floor((F.col("o_w") - F.col("w")) / 2)).cast("int").alias("x"),
        (F.col("y") + F.floor((F.col("o_h") - F.col("h")) / 2)).cast("int").alias("y"),
        F.col("grey").alias("grey_g"), F.col("content").alias("c_g"))
    return left.join(right, ["pair_id", "x", "y"], "left").select(
        "pair_id", "w", "h", "x", "y", "grey_o", F.coalesce("grey_g", F.lit(float(dims.NEUTRAL_GREY))).alias("grey_g"),
        F.greatest("c_o", F.coalesce("c_g", F.lit(0))).alias("region"))


def frame_edges(frames: DataFrame) -> DataFrame:
    """Edge flags of both sides, found in one run with the side as a second key."""
    sides = frames.select("pair_id", "w", "h", "x", "y", F.explode(F.create_map(
        F.lit("o"), F.col("grey_o"), F.lit("g"), F.col("grey_g"))).alias("side", "level"))
    keys = ("pair_id", "side")
    soft = kernels.separable(sides, {"blur": ("level", [0.25, 0.5, 0.25], [0.25, 0.5, 0.25])}, keys)
    soft = soft.withColumn("blur", half_even(F.col("blur")))
    edges = kernels.edge_map(soft, "blur", 40.0, 110.0, keys)
    flag = lambda s: F.bool_or((F.col("side") == s) & F.col("edge"))
    return edges.groupBy("pair_id", "w", "h", "x", "y").agg(
        flag("o").alias("edge_o"), flag("g").alias("edge_g"))


def detail_scores(frames: DataFrame) -> DataFrame:
    """Better of hash and structure similarity, per pair."""
    grey = frames.select("pair_id", "w", "h", "x", "y", F.explode(F.create_map(
        F.lit("o"), F.col("grey_o"), F.lit("g"), F.col("grey_g"))).alias("side", "grey"))
    hashed = phash256(grey, keys=("pair_id", "side")).groupBy("pair_id").agg(*[
        F.max(F.when(F.col("side") == s, F.col("words"))).alias(f"{s}_words") for s in ("o", "g")])
    both = hashed.select("pair_id", hash_similarity(F.col("o_words"), F.col("g_words"), 256).alias("phash_pct"))
    return both.join(ssim(frames), "pair_id").select(
        "pair_id", "phash_pct", (F.col("ssim") * 100).alias("ssim_pct"),
        detail(F.col("phash_pct"), F.col("ssim") * 100).alias("detail_pct"))


def overall_score() -> Column:
    w = dims.OVERALL_WEIGHTS
    return half_even(F.round(
        F.col("detail_pct") * w["detail"] + F.col("shape_pct") * w["shape"]
        + F.col("edges_pct") * w["edges"] + F.col("colour_pct") * w["colour"], 9)).cast("int")


def background_note() -> Column:
    word = lambda c: F.when(F.col(c), "transparent").otherwise("opaque")
    return F.when(
        F.col("o_has_alpha") == F.col("g_has_alpha"),
        F.concat(F.lit("Background: "), word("o_has_alpha"), F.lit(" in both")),
    ).otherwise(F.concat(
        F.lit("Background: "), word("o_has_alpha"), F.lit(" in original, "), word("g_has_alpha"), F.lit(" in result")))


def pair_score(pairs: DataFrame, pixels: DataFrame, long_side: int = dims.COMPARE_LONG_SIDE,
               whole: int = stacks.WHOLE_PIXELS) -> DataFrame:
    """Shape, colour, edge and detail scores and their blend for every pair.

    Pairs of images of at most ``whole`` pixels are scored inside tasks, many at a time; the pixels of any other spread
    over tasks, with the same result.
    """
    images = cut_lineage(stacks.packed(pixels, whole))
    both = pair_up(pairs, images)
    large = images.filter("body is null")
    out = whole_scores(both.filter("o_body is not null and g_body is not null"), long_side)
    if not large.isEmpty():
        rest = cut_lineage(both.filter("o_body is null or g_body is null").select(*pairs.columns))
        used = rest.select(F.explode(F.array("original_id", "generated_id")).alias("image_id")).distinct()
        out = out.unionByName(spread_scores(rest, pixels.join(used, "image_id", "left_semi"), long_side))
    return out.withColumn("overall_pct", overall_score())


def blended() -> list[Column | str]:
    """What ``pair_score`` takes from both images' features."""
    return [
        "pair_id", "original_id", "generated_id", shape_similarity().alias("shape_pct"),
        colour_similarity().alias("colour_pct"), colour_matches().alias("colour_matches"),
        F.coalesce(F.size("o_dominant"), F.lit(0)).alias("colour_total"),
        background_note().alias("background_note"),
        (F.col("o_has_alpha") != F.col("g_has_alpha")).alias("background_changed")]


def detail(phash: Column, structure: Column) -> Column:
    """Better of hash and structure similarity, both in percent."""
    return half_even(F.round(F.greatest(phash, structure), 9)).cast("int")


def whole_scores(both: DataFrame, long_side: int) -> DataFrame:
    found = stacks.pair_figures(both, long_side, SSIM_TAPS)
    none_o, none_g = F.col("o_n_edges") == 0, F.col("g_n_edges") == 0
    edges = F.when(none_o & none_g, 1.0).when(none_o | none_g, 0.0).otherwise(
        f1(F.col("o_hits") / F.col("o_n_edges"), F.col("g_hits") / F.col("g_n_edges")))
    phash = hash_similarity(F.col("o_words"), F.col("g_words"), 256)
    return found.select(
        *blended(), half_even(F.round(edges * 100, 9)).cast("int").alias("edges_pct"), phash.alias("phash_pct"),
        (F.col("ssim") * 100).alias("ssim_pct"), detail(phash, F.col("ssim") * 100).alias("detail_pct"))


def spread_scores(pairs: DataFrame, pixels: DataFrame, long_side: int) -> DataFrame:
    """Scores of images of any size. Features and grey views are made once per image, however many pairs use it; the
    common frames are checkpointed because edges, hashes and structure all read them."""
    joined = pair_up(pairs, image_features(pixels))
    scored = joined.select(*blended())
    views = cut_lineage(transforms.neutral_grey(transforms.content_mask_connected(pixels), long_side))
    frames = cut_lineage(common_frames(pairs, views))
    edges = edge_f1(frame_edges(frames)).select(
        "pair_id", half_even(F.round(F.col("edge_f1") * 100, 9)).cast("int").alias("edges_pct"))
    return scored.join(edges, "pair_id").join(detail_scores(frames), "pair_id")
