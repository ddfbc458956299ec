"""Per-image figures: boxes, layout, shape, alpha, black level, target print size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa import dims
from rasterqa.functions.numbers import count_where, fixed, half_even, luminance, orientation, share_where


def bbox(pixels: DataFrame, content: str = "content", keys=("image_id",)) -> DataFrame:
    """Tight box ``bx, by, bw, bh`` of the marked pixels; NULLs where nothing is marked."""
    on = lambda c: F.when(F.col(content), F.col(c))
    agg = pixels.groupBy(*keys).agg(
        F.min(on("x")).alias("x0"), F.max(on("x")).alias("x1"),
        F.min(on("y")).alias("y0"), F.max(on("y")).alias("y1"),
        F.first("w").alias("w"), F.first("h").alias("h"),
        count_where(F.col(content)).alias("n_content"),
    )
    return agg.select(
        *keys, "w", "h", "n_content",
        F.col("x0").alias("bx"), F.col("y0").alias("by"),
        (F.col("x1") - F.col("x0") + 1).alias("bw"), (F.col("y1") - F.col("y0") + 1).alias("bh"),
    )


def layout_metrics(boxes: DataFrame, dpi: int = dims.DEFAULT_DPI) -> DataFrame:
    """Paddings, centre, margins and print inches of a boxed image."""
    right = F.col("w") - (F.col("bx") + F.col("bw"))
    bottom = F.col("h") - (F.col("by") + F.col("bh"))
    smallest = F.least("bx", "by", right, bottom)
    return boxes.select(
        "*",
        F.col("bx").alias("pad_left"), right.alias("pad_right"),
        F.col("by").alias("pad_top"), bottom.alias("pad_bottom"),
        half_even((F.col("bx") + F.col("bw") / 2.0) * 100.0 / F.col("w"), 2).alias("center_x_pct"),
        half_even((F.col("by") + F.col("bh") / 2.0) * 100.0 / F.col("h"), 2).alias("center_y_pct"),
        orientation(F.col("w"), F.col("h")).alias("orientation"),
        half_even(F.col("w") / F.col("h"), 4).alias("aspect_ratio"),
        half_even(F.col("w") / F.lit(float(dpi)), 2).alias("inches_w"),
        half_even(F.col("h") / F.lit(float(dpi)), 2).alias("inches_h"),
        half_even(F.coalesce(F.col("bx") / F.col("w"), F.lit(0.0)), 3).alias("margin_left"),
        half_even(F.coalesce(right / F.col("w"), F.lit(0.0)), 3).alias("margin_right"),
        half_even(F.coalesce(F.col("by") / F.col("h"), F.lit(0.0)), 3).alias("margin_top"),
        half_even(F.coalesce(bottom / F.col("h"), F.lit(0.0)), 3).alias("margin_bottom"),
        F.coalesce(smallest * 100.0 / F.least("w", "h"), F.lit(100.0)).alias("margin_pct"),
    )


def shape_features(pixels: DataFrame, content: str = "content", keys=("image_id",)) -> DataFrame:
    """Box aspect, fill and centroid as box fractions (0, 0, .5, .5 over no content)."""
    on = lambda c: F.when(F.col(content), F.col(c))
    agg = pixels.groupBy(*keys).agg(
        F.min(on("x")).alias("x0"), F.max(on("x")).alias("x1"),
        F.min(on("y")).alias("y0"), F.max(on("y")).alias("y1"),
        F.avg(on("x")).alias("mx"), F.avg(on("y")).alias("my"),
        count_where(F.col(content)).alias("n_content"),
    )
    bw, bh = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return agg.select(
        *keys, "n_content",
        F.coalesce(bw / bh, F.lit(0.0)).alias("aspect"),
        F.coalesce(F.least(F.lit(1.0), F.col("n_content") / (bw * bh)), F.lit(0.0)).alias("fill"),
        F.coalesce((F.col("mx") - F.col("x0")) / bw, F.lit(0.5)).alias("cx"),
        F.coalesce((F.col("my") - F.col("y0")) / bh, F.lit(0.5)).alias("cy"),
        F.coalesce(bw * bh, F.lit(0)).cast("bigint").alias("box_area"),
    )


def contour_features(comps: DataFrame) -> DataFrame:
    """Outer regions above 0.5% of the content, and the largest one's share of the box.

    ``comps`` is what ``components.nesting`` gives: regions inside another's hole belong to the
    content but count as no outer region. Region size is its pixel count.
    """
    outer = F.when(F.col("hole").isNull(), F.col("area"))
    whole = comps.groupBy("image_id").agg(
        F.sum("area").alias("content_px"),
        ((F.max("x1") - F.min("x0") + 1) * (F.max("y1") - F.min("y0") + 1)).alias("box_area"),
        F.max(outer).alias("largest"),
    )
    counted = (
        comps.join(whole, "image_id")
        .groupBy("image_id", "largest", "box_area")
        .agg(count_where(F.coalesce(outer, F.lit(0)) > F.col("content_px") * 0.005).alias("n_contours"))
    )
    return counted.select(
        "image_id", "n_contours",
        half_even(F.col("largest") / F.col("box_area"), 3).alias("largest_contour_share"),
    )


def alpha_colour_stats(pixels: DataFrame) -> DataFrame:
    """Mean content colour, see-through share, fully clear and semi-transparent shares."""
    mean = lambda c: F.coalesce(
        half_even(F.avg(F.when(F.col("content"), F.col(c)))).cast("int"), F.lit(0)
    ).alias(f"mean_{c}")
    lo, hi = dims.SEMI_ALPHA
    return pixels.groupBy("image_id").agg(
        mean("r"), mean("g"), mean("b"),
        half_even(share_where(F.col("a") < 128) * 100.0, 1).alias("transparent_pct"),
        half_even(share_where(F.col("a") == 0) * 100.0, 1).alias("clear_pct"),
        half_even(share_where(F.col("a").between(lo, hi)) * 100.0, 2).alias("semi_pct"),
    )


def black_level(pixels: DataFrame, content: str = "content") -> DataFrame:
    """1st percentile of content luminance; NULL where under 2% of it is dark.

    Luminance is judged to three decimals, so the percentile's value table stays small
    and does not depend on the order sums are taken in.
    """
    lum = F.round(luminance(), 3)
    on = F.when(F.col(content), lum)
    agg = pixels.groupBy("image_id").agg(
        F.avg(F.when(on < dims.BLACK_MIN_LUM, 1.0).when(on.isNotNull(), 0.0)).alias("in_content"),
        share_where(lum < dims.BLACK_MIN_LUM).alias("in_all"),
        F.percentile(on, 0.01).alias("p_content"), F.percentile(lum, 0.01).alias("p_all"),
    )
    dark = F.coalesce("in_content", "in_all") * 100.0
    level = F.coalesce("p_content", "p_all")
    return agg.select(
        "image_id", dark.alias("dark_pct"),
        F.when(dark >= dims.BLACK_MIN_SHARE_PCT, level).alias("black_level"),
    )


ALPHA_BUCKETS = [("0", 0, 0), ("1_10", 1, 10), ("11_50", 11, 50),
                 ("51_200", 51, 200), ("201_254", 201, 254), ("255", 255, 255)]


def alpha_histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(
        *[count_where(F.col("a").between(lo, hi)).alias(f"alpha_{n}") for n, lo, hi in ALPHA_BUCKETS]
    )


def target_geometry(boxes: DataFrame, width_in: Column, dpi: Column) -> DataFrame:
    """Print target from the content box: px = inches x dpi, height from the box ratio."""
    height_in = width_in * F.col("bh") / F.col("bw")
    sized = boxes.select(
        "*", half_even(width_in, 2).alias("target_width_in"),
        half_even(height_in, 2).alias("target_height_in"),
        F.when(height_in.isNotNull(), half_even(width_in * dpi).cast("bigint")).alias("target_width_px"),
        half_even(height_in * dpi).cast("bigint").alias("target_height_px"),
    )
    return sized.select(
        "*",
        half_even(F.col("target_width_px") / F.when(F.col("target_height_px") != 0, F.col("target_height_px")), 4)
        .alias("target_aspect_ratio"),
        half_even(F.col("w") / F.col("target_width_in"), 1).alias("effective_dpi_x"),
        half_even(F.col("h") / F.when(F.col("target_height_in") != 0, F.col("target_height_in")), 1)
        .alias("effective_dpi_y"),
    )


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a fold; 93 steps end for any two BIGINTs (Fibonacci numbers take longest)."""
    start = F.struct(a.cast("bigint").alias("p"), b.cast("bigint").alias("q"))

    def step(acc, _):
        done = acc["q"] == 0
        return F.struct(
            F.when(done, acc["p"]).otherwise(acc["q"]).alias("p"),
            F.when(done, F.lit(0)).otherwise(acc["p"] % acc["q"]).cast("bigint").alias("q"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda acc: acc["p"])


def ratio_info(sizes: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    """Reduced ratio, its ``1 : X.XX`` form, and the nearest standard placement."""
    g = gcd(F.col(w), F.col(h))
    rw, rh = (F.col(w) / g).cast("bigint"), (F.col(h) / g).cast("bigint")
    ratio = F.col(w) / F.col(h)
    factor = fixed(F.greatest(w, h) / F.least(w, h), 2)
    reduced = F.concat(rw.cast("string"), F.lit(":"), rh.cast("string"))
    plain = F.concat(F.col(w).cast("string"), F.lit(":"), F.col(h).cast("string"))
    gaps = F.array(*[
        F.struct(F.abs(F.log(ratio / s)).alias("gap"), F.lit(i).alias("pos"), F.lit(label).alias("label"))
        for i, (s, label) in enumerate(dims.PLACEMENTS)
    ])
    return sizes.select(
        "*", reduced.alias("ratio"),
        F.when(F.col(w) <= F.col(h), F.concat(plain, F.lit(" (1 : "), factor, F.lit(")")))
        .otherwise(F.concat(plain, F.lit(" ("), factor, F.lit(" : 1)"))).alias("ratio_normalised"),
        F.when(F.greatest(rw, rh) <= 50, reduced)
        .otherwise(F.concat(fixed(ratio, 2), F.lit(":1"))).alias("aspect_text"),
        F.array_min(gaps)["label"].alias("nearest_placement"),
    )
