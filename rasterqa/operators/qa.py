"""Print-readiness: 13 checks, weighted score, band and text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa import dims
from rasterqa.functions.numbers import count_where, fixed, half_even, px_to_mm, share_where
from rasterqa.operators import colour, components as cc, kernels, masks, metrics, stacks
from rasterqa.session import cut_lineage

THRESHOLD = {row[0]: row for row in dims.QA_THRESHOLDS}


def status(value: Column, warn: Column, fail: Column, direction: Column) -> Column:
    """pass / warn / fail. High is bad from the threshold on, low is bad only below it."""
    high = F.when(value >= fail, "fail").when(value >= warn, "warn").otherwise("pass")
    low = F.when(value < fail, "fail").when(value < warn, "warn").otherwise("pass")
    return F.when(value.isNull() | F.isnan(value), "na").when(direction == "high", high).otherwise(low)


def pixel_figures(masked: DataFrame) -> DataFrame:
    """Everything one pass of hash aggregation can give, per image."""
    lo, hi = dims.SEMI_ALPHA
    on = lambda c: F.when(F.col("content"), F.col(c))
    agg = masked.groupBy("image_id").agg(
        F.first("w").alias("w"), F.first("h").alias("h"), F.first("has_alpha").alias("has_alpha"),
        count_where(F.col("content")).alias("n_content"),
        (share_where(F.col("a") == 0) * 100.0).alias("clear_pct"),
        (share_where(F.col("a").between(lo, hi)) * 100.0).alias("semi_pct"),
        F.min(on("x")).alias("x0"), F.max(on("x")).alias("x1"),
        F.min(on("y")).alias("y0"), F.max(on("y")).alias("y1"),
    )
    edge = F.least("x0", "y0", F.col("w") - 1 - F.col("x1"), F.col("h") - 1 - F.col("y1"))
    return agg.select(
        "image_id", "w", "h", "has_alpha", "n_content", "clear_pct", "semi_pct",
        F.when(F.col("n_content") == 0, 100.0)
        .otherwise(edge * 100.0 / F.least("w", "h")).alias("margin_pct"),
    )


def qa_measurements(pixels: DataFrame, dpi: int = dims.DEFAULT_DPI) -> DataFrame:
    """One wide row per image with every measured value behind the checks.

    A ``dpi`` column of the pixels holds each file's own resolution; ``dpi`` stands in where there is none.
    Each branch ends in a per-image aggregate, so the joins below move one row per
    image however large the rasters are.
    """
    masked = cut_lineage(masks.content_mask(pixels, "qa"))  # read by every branch below
    dpis = cut_lineage(kernels.image_dpi(pixels, dpi))
    base = pixel_figures(masked)
    alpha = masked.filter("has_alpha")
    pseudo = kernels.with_pseudo_alpha(masked.filter("not has_alpha")).select(
        "image_id", "w", "h", "x", "y", F.col("pseudo_a").alias("level"))
    levels = alpha.select("image_id", "w", "h", "x", "y", F.col("a").cast("double").alias("level")).unionByName(pseudo)
    comps = cc.components(masked.filter("content").select("image_id", "x", "y"), 8)
    parts = [
        kernels.halo_pct(alpha).select("image_id", "halo_pct"),
        kernels.soft_edge_pct(levels, "level").select("image_id", "soft_edge_pct"),
        colour.palette_profile(masked),
        metrics.black_level(masked),
        kernels.min_stroke(masked, dpis),
        kernels.min_feature(comps.join(dpis, "image_id"), F.col("dpi")),
        dpis,
        kernels.gradient_pct(masked),
    ]
    out = base
    for part in parts:
        out = out.join(part, "image_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select(
        *base.columns, "dpi", "halo_pct", zero("soft_edge_pct"),
        F.coalesce("colour_count", F.lit(0)).cast("double").alias("colour_count"),
        F.coalesce("top_colours", F.lit("")).alias("top_colours"), "dark_pct", "black_level",
        zero("min_stroke_px"), zero("min_feature_px"), zero("gradient_pct"),
    )


def qa_of_small(pixels: DataFrame, dpi: int = dims.DEFAULT_DPI, whole: int = stacks.WHOLE_PIXELS) -> DataFrame:
    """``qa_measurements`` without ``top_colours`` for many small images, all at one ``dpi``.

    Images of at most ``whole`` pixels that need no shrunken copy are measured inside tasks, many at a time; any other
    by ``qa_measurements``, with the same values.
    """
    images = cut_lineage(stacks.packed(pixels, whole))
    small = F.col("body").isNotNull() & (F.greatest("w", "h") <= dims.ANALYSIS_LONG_SIDE)
    out = stacks.measurements(images.filter(small), float(dpi))
    large = images.filter(~small).select("image_id")
    if not large.isEmpty():
        rest = qa_measurements(pixels.join(large, "image_id", "left_semi"), dpi)
        out = out.unionByName(rest.select(*out.columns))
    return out


def qa_checks(measured: DataFrame) -> DataFrame:
    """Thirteen rows per image: value, text, status, weight.

    A check that does not apply is ``na`` with weight 0 and is never scored.
    """
    inches = F.greatest(F.col("w") / F.col("dpi"), F.col("h") / F.col("dpi"))
    mm = lambda c: px_to_mm(F.col(c), F.col("dpi"))
    values = {
        "dpi": (F.col("dpi"), 1, F.concat(fixed(F.col("dpi"), 0), F.lit(" DPI"))),
        "transparency": (F.col("clear_pct"), 1, F.concat(
            F.when(F.col("has_alpha"), "present").otherwise("none"), F.lit(", "),
            fixed(F.col("clear_pct"), 1), F.lit("% fully clear"))),
        "semi_alpha": (F.col("semi_pct"), 2, F.concat(fixed(F.col("semi_pct"), 2), F.lit("%"))),
        "halo": (F.when(F.col("has_alpha"), F.col("halo_pct")), 2,
                 F.concat(fixed(F.col("halo_pct"), 2), F.lit("%"))),
        "soft_edges": (F.col("soft_edge_pct"), 1, F.concat(fixed(F.col("soft_edge_pct"), 1), F.lit("% soft"))),
        "colours": (F.col("colour_count"), 0, F.concat(fixed(F.col("colour_count"), 0), F.lit(" colours"))),
        "black": (F.col("black_level"), 1, F.concat(F.lit("darkest ~"), fixed(F.col("black_level"), 0), F.lit("/255"))),
        "min_stroke": (mm("min_stroke_px"), 2, F.concat(
            fixed(mm("min_stroke_px"), 2), F.lit(" mm ("), fixed(F.col("min_stroke_px"), 0), F.lit("px)"))),
        "min_feature": (mm("min_feature_px"), 2, F.concat(
            fixed(mm("min_feature_px"), 2), F.lit(" mm ("), fixed(F.col("min_feature_px"), 0), F.lit("px)"))),
        "gradients": (F.col("gradient_pct"), 1, F.concat(fixed(F.col("gradient_pct"), 1), F.lit("%"))),
        "margins": (F.col("margin_pct"), 2, F.concat(fixed(F.col("margin_pct"), 2), F.lit("% of short side"))),
        "aspect": (F.lit(0.0), 0, F.col("aspect_text")),
        "print_size": (inches, 2, F.concat(fixed(inches, 2), F.lit(" in widest"))),
    }
    entries = []
    for pos, (cid, (raw, digits, text)) in enumerate(values.items()):
        if cid in THRESHOLD:
            _, warn, fail, weight, direction = THRESHOLD[cid]
            state = status(raw, F.lit(warn), F.lit(fail), F.lit(direction))
            limits = f"{warn:g}/{fail:g}"
        else:
            weight = dims.INFO_WEIGHTS[cid]
            state = F.when(F.col("has_alpha"), "pass").otherwise("warn") if cid == "transparency" else F.lit("pass")
            limits = "informational"
        entries.append(F.struct(
            F.lit(pos).alias("pos"), F.lit(cid).alias("id"), F.lit(dims.QA_LABELS[cid]).alias("label"),
            half_even(raw.cast("double"), digits).alias("value"),
            F.when(state == "na", "n/a").otherwise(text).alias("value_str"),
            F.lit(limits).alias("threshold_str"), state.alias("status"),
            F.when(state == "na", 0).otherwise(weight).alias("weight"),
        ))
    sized = metrics.ratio_info(measured).drop("ratio", "ratio_normalised")
    return sized.select("image_id", F.inline(F.array(*entries)))


def score_of(credit: Column, weight: Column) -> Column:
    """Weighted mean of credits in percent, whole number; 0 over no scored check."""
    total = F.sum(weight)
    return F.coalesce(half_even(F.sum(credit * weight) * 100.0 / F.when(total != 0, total)), F.lit(0.0)).cast("int")


def band_of(score: Column) -> Column:
    return (
        F.when(score >= dims.BAND_READY, "ready").when(score >= dims.BAND_FIXABLE, "fixable").otherwise("not_ready")
    )


def qa_report(checks: DataFrame, keys=("image_id",)) -> DataFrame:
    """Score and band; ``na`` leaves numerator and denominator."""
    credit = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0)
    counted = F.when(F.col("status").isin("pass", "warn", "fail"), F.col("weight")).otherwise(0)
    tally = lambda s: count_where(F.col("status") == s).alias(f"n_{s}")
    out = checks.groupBy(*keys).agg(
        score_of(credit, counted).alias("score"), tally("pass"), tally("warn"), tally("fail"), tally("na"))
    return out.withColumn("band", band_of(F.col("score")))


BAND_LABEL = {"ready": "PRINT READY", "fixable": "FIXABLE", "not_ready": "NOT READY"}


def qa_summary(checks: DataFrame, reports: DataFrame) -> DataFrame:
    """Text report per image: fails, warnings, passes, then what did not apply."""
    rank = (
        F.when(F.col("status") == "fail", 0).when(F.col("status") == "warn", 1)
        .when(F.col("status") == "pass", 2).otherwise(3)
    )
    line = F.concat(
        F.lit("["), F.rpad(F.upper("status"), 4, " "), F.lit("] "), F.col("label"), F.lit(": "), F.col("value_str"),
        F.when(F.col("threshold_str") != "informational",
               F.concat(F.lit("  (threshold: "), F.col("threshold_str"), F.lit(")"))).otherwise(""),
    )
    lines = checks.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("r"), (-F.col("weight")).alias("w"), "pos", line.alias("t")))).alias("ls"))
    label = F.create_map(*[F.lit(v) for kv in BAND_LABEL.items() for v in kv])
    head = F.concat(F.lit("PRINT READY QA - score "), F.col("score"), F.lit("/100 ("), label[F.col("band")], F.lit(")"))
    return lines.join(reports, "image_id").select(
        "image_id", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("ls", lambda s: s["t"]), "\n")).alias("summary"))


def qa_pairs(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """Scores of both sides of each pair ``(pair_id, original_id, generated_id)``."""
    roles = pairs.select("pair_id", F.explode(F.create_map(
        F.lit("original"), F.col("original_id"), F.lit("generated"), F.col("generated_id"))).alias("role", "image_id"))
    return roles.join(reports, "image_id")
