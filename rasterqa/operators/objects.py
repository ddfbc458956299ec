"""Object-level comparison of image pairs, and drift of finished jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa.operators import compare, masks, qa, replies, transforms
from rasterqa.operators import components as cc
from rasterqa.session import cut_lineage

PAD = 0.03
BG_TOLERANCE = 48


def object_boxes(objects: DataFrame) -> DataFrame:
    """Box of every object in both images ``(pair_id, id, side, x, y, w, h, large)``."""
    sides = objects.select("pair_id", "id", F.explode(F.create_map(
        F.lit("o"), F.col("cells_1"), F.lit("g"), F.col("cells_2"))).alias("side", "cells"))
    tokens = sides.select(F.concat_ws(":", "pair_id", "id", "side").alias("object_id"), F.explode("cells").alias("cell"))
    return replies.cells_to_bbox(tokens, max_fraction=1.0, max_span=10)


def crop_edges(box_size: str, at: str, size: str) -> tuple[Column, Column]:
    lo = F.greatest(F.lit(0.0), F.col(at) - PAD)
    hi = F.least(F.lit(1.0), F.col(at) + F.col(box_size) + PAD)
    return F.rint(lo * F.col(size)).cast("int"), F.rint(hi * F.col(size)).cast("int")


def object_pairs(objects: DataFrame, pairs: DataFrame, pixels: DataFrame, long_side: int) -> DataFrame:
    """Status of every listed object; paired ones with similarity and both QA scores.

    ``objects(pair_id, id, name, type, cells_1, cells_2)``: NULL cells mean "missing".
    Similarity runs on crops with the flat background of their own image removed, QA on
    the crops as they are.
    """
    boxes = object_boxes(objects)
    named = objects.select("*", F.concat_ws(":", "pair_id", "id").alias("key"))
    side = lambda s: boxes.filter(F.col("object_id").endswith(f":{s}")).select(
        F.regexp_replace("object_id", f":{s}$", "").alias("key"), F.struct("x", "y", "w", "h", "large").alias(f"box_{s}"))
    located = named.join(side("o"), "key", "left").join(side("g"), "key", "left")
    judged = cut_lineage(replies.pair_status(located.select(
        "key", "pair_id", "id", "name", "type", F.size("cells_1").alias("n1"), F.size("cells_2").alias("n2"),
        F.col("box_o.x").alias("x1"), F.col("box_g.x").alias("x2"), "box_o", "box_g")))
    paired = judged.filter("status = 'paired'")

    size = pixels.groupBy("image_id").agg(F.first("w").alias("iw"), F.first("h").alias("ih"))
    wanted = paired.join(pairs, "pair_id").select("key", F.explode(F.create_map(
        F.lit("o"), F.struct(F.col("original_id").alias("image_id"), F.col("box_o").alias("b")),
        F.lit("g"), F.struct(F.col("generated_id").alias("image_id"), F.col("box_g").alias("b")))).alias("side", "s"))
    edges = wanted.select(F.concat_ws(":", "key", "side").alias("n"), "s.image_id", "s.b.*").join(size, "image_id")
    (x0, x1), (y0, y1) = crop_edges("w", "x", "iw"), crop_edges("h", "y", "ih")
    edges = edges.select("image_id", "n", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).filter("x1 > x0 and y1 > y0")
    source = transforms.cut_ranges(pixels, edges)
    crops = cut_lineage(source)

    bg = masks.background_colour(pixels, "flat")
    near = F.coalesce(masks.background_distance() <= BG_TOLERANCE, F.lit(False))
    flagged = crops.join(bg, "image_id").withColumn("near_bg", near).drop("image_id", "bg_r", "bg_g", "bg_b").withColumnRenamed("n", "image_id")
    cleaned = cc.border_connected(flagged, "near_bg", "is_bg").withColumn(
        "a", F.when(F.col("is_bg"), 0).otherwise(F.col("a"))).drop("near_bg", "is_bg")
    together = paired.select(F.col("key").alias("pair_id"), F.concat("key", F.lit(":o")).alias("original_id"),
                             F.concat("key", F.lit(":g")).alias("generated_id"))
    scores = compare.pair_score(together, cut_lineage(cleaned), long_side).select(
        F.col("pair_id").alias("key"), "overall_pct", "detail_pct", "shape_pct", "edges_pct", "colour_pct")
    as_given = crops.drop("image_id").withColumnRenamed("n", "image_id")
    report = qa.qa_report(qa.qa_checks(qa.qa_of_small(as_given))).select("image_id", "score")
    qa_of = lambda s: report.filter(F.col("image_id").endswith(f":{s}")).select(
        F.regexp_replace("image_id", f":{s}$", "").alias("key"), F.col("score").alias(f"qa_{s}"))
    out = judged.join(scores, "key", "left").join(qa_of("o"), "key", "left").join(qa_of("g"), "key", "left")
    large = F.coalesce(F.col("box_o.large") | F.col("box_g.large"), F.lit(False))
    return out.select("pair_id", "id", "name", "status", large.alias("large_area"), "overall_pct", "detail_pct",
                      "shape_pct", "edges_pct", "colour_pct", "qa_o", "qa_g")


def ready_jobs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs whose both files are on disk and that carry no score yet; the rest wait."""
    landed = lambda c: files.select(F.col("image_id").alias(c))
    todo = jobs.filter("score is null and original_id is not null and generated_id is not null")
    return todo.join(landed("original_id"), "original_id", "left_semi").join(landed("generated_id"), "generated_id", "left_semi")


def drift_scores(jobs: DataFrame, files: DataFrame, pixels: DataFrame, long_side: int) -> DataFrame:
    """Like-for-like drift per job: the baseline padded to the job's target ratio against
    the result (``ratio`` NULL or 0 compares as is)."""
    ready = cut_lineage(ready_jobs(jobs, files))
    base = pixels.withColumnRenamed("image_id", "original_id").join(ready.select("pair_id", "original_id", "ratio"), "original_id")
    padded = transforms.fit_to_ratio(base, F.when(F.coalesce("ratio", F.lit(0.0)) > 0, F.col("ratio")).otherwise(F.col("w") / F.col("h")))
    left = transforms.fill_canvas(
        padded.select(F.concat(F.col("pair_id"), F.lit(":o")).alias("image_id"), "w", "h", "x", "y", "r", "g", "b", "a"),
        {"r": 0, "g": 0, "b": 0, "a": 0})
    right = pixels.withColumnRenamed("image_id", "generated_id").join(ready.select("pair_id", "generated_id"), "generated_id").select(
        F.concat(F.col("pair_id"), F.lit(":g")).alias("image_id"), "w", "h", "x", "y", "r", "g", "b", "a")
    together = ready.select("pair_id", F.concat("pair_id", F.lit(":o")).alias("original_id"), F.concat("pair_id", F.lit(":g")).alias("generated_id"))
    scored = compare.pair_score(together, cut_lineage(left.unionByName(right)), long_side)
    return scored.select("pair_id", "overall_pct", "detail_pct", "shape_pct", "edges_pct", "colour_pct")
