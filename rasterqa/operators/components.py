"""Connected components of masks, as graph work on row runs.

Nodes are horizontal runs of mask pixels. Images are cut into strips of rows; a strip's
runs are labelled where they lie (one shuffle, bounded memory), so only runs on strip
borders are left as a graph. Its labels come from alternating large-star / small-star
rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): O(log^2 n)
rounds whatever the shape, each two equi-joins and checkpointed. No image is ever
gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterqa.session import cut_lineage

BUCKET = 64
STRIP = 256
#: Run ids hold an image side in 20 bits; one more for the reach beyond it.
SIDE_BITS = 21


def runs(mask: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Maximal horizontal runs ``(keys, strip, y, x0, x1, run_id)`` of a sparse mask."""
    cut = mask.select(*keys, F.floor(F.col("y") / STRIP).cast("int").alias("strip"), "y", "x")
    row = Window.partitionBy(*keys, "strip", "y").orderBy("x")
    grouped = cut.withColumn("grp", F.col("x") - F.row_number().over(row))
    return (
        grouped.groupBy(*keys, "strip", "y", "grp")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("grp")
        .withColumn("run_id", F.shiftleft(F.col("y").cast("bigint"), 20) + F.col("x0"))
    )


def _least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least node of each node's component, for edges (u, v) over 0..n-1.

    Each root hooks onto the least root an edge leads to, then paths are shortened until every
    node points at its root; edges inside one tree are done with. All are array steps.
    """
    parent = np.arange(n)
    while len(u):
        ru, rv = parent[u], parent[v]
        low = np.minimum(ru, rv)
        np.minimum.at(parent, np.maximum(ru, rv), low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        left = parent[u] != parent[v]
        u, v = u[left], v[left]
    return parent


def _strip_labels(pdf: pd.DataFrame, unit: np.ndarray, reach: int) -> np.ndarray:
    """Least run id of each run's component within its strip, rows in (unit, y, x0) order.

    Runs of a row are disjoint and sorted, so those that touch a run of the next row are a
    stretch found by two binary searches over (row, x).
    """
    # A row number with a gap before every strip; x moves by 2 so that x - reach stays positive.
    row = unit.astype(np.int64) * (2 * STRIP) + pdf["y"].to_numpy().astype(np.int64) % STRIP + 1
    x0, x1 = (pdf[c].to_numpy().astype(np.int64) + 2 for c in ("x0", "x1"))
    above = (row - 1) << SIDE_BITS
    first = np.searchsorted((row << SIDE_BITS) + x1, above + x0 - reach, "left")
    last = np.searchsorted((row << SIDE_BITS) + x0, above + x1 + reach, "right")
    many = np.maximum(last - first, 0)
    below = np.repeat(np.arange(len(pdf)), many)
    touched = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return pdf["run_id"].to_numpy()[_least_labels(touched, below, len(pdf))]


def _label_strips(run: DataFrame, keys: tuple[str, ...], reach: int) -> DataFrame:
    """Add ``local``, the strip-wise label. Runs are sent to their strip right before the sort, so a
    strip is whole whatever plan made them; only the last, unfinished strip of a batch is held back
    for the next one."""
    unit_keys = [*keys, "strip"]

    def label(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = None
            if pdf.empty:
                continue
            new = np.r_[False, np.any([(pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1]) for k in unit_keys], axis=0)]
            unit = np.cumsum(new)
            done = unit < unit[-1]
            held = pdf[~done].reset_index(drop=True)
            if done.any():
                part = pdf[done].reset_index(drop=True)
                yield part.assign(local=_strip_labels(part, unit[done], reach))
        if held is not None:
            yield held.assign(local=_strip_labels(held, np.zeros(len(held), int), reach))

    schema = T.StructType([*run.schema.fields, T.StructField("local", T.LongType())])
    return run.repartition(*unit_keys).sortWithinPartitions(*unit_keys, "y", "x0").mapInPandas(label, schema)


def _touching(run: DataFrame, keys: tuple[str, ...], reach: int) -> DataFrame:
    """Edges ``(keys, u, v)`` with u > v between strip labels that touch across a border.

    Both sides carry the x-buckets they cover; a pair is kept only in the bucket where
    its overlap starts, so it comes out once and wide rows stay an equi-join.
    """
    spread = lambda lo, hi: F.explode(
        F.sequence(F.floor(lo / BUCKET).cast("int"), F.floor(hi / BUCKET).cast("int"))
    )
    upper = run.filter(F.col("y") % STRIP == STRIP - 1).select(
        *keys, (F.col("y") + 1).alias("y"), F.col("local").alias("v"),
        F.col("x0").alias("a0"), F.col("x1").alias("a1"),
        spread(F.col("x0"), F.col("x1")).alias("bucket"),
    )
    lower = run.filter((F.col("y") % STRIP == 0) & (F.col("y") > 0)).select(
        *keys, "y", F.col("local").alias("u"),
        (F.col("x0") - reach).alias("b0"), (F.col("x1") + reach).alias("b1"),
        spread(F.col("x0") - reach, F.col("x1") + reach).alias("bucket"),
    )
    start = F.greatest("a0", "b0")
    return (
        lower.join(upper, [*keys, "y", "bucket"])
        .filter((F.col("a0") <= F.col("b1")) & (F.col("a1") >= F.col("b0")))
        .filter(F.floor(start / BUCKET) == F.col("bucket"))
        .select(*keys, "u", "v")
    )


def _large_star(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    both = edges.select(*keys, "u", "v").union(
        edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
    )
    low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.filter("v > u").join(low, [*keys, "u"])
        .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    low = edges.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    linked = edges.join(low, [*keys, "u"])
    moved = linked.filter("v > m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select(*keys, "u", F.col("m").alias("v")).union(moved).distinct()


def _is_star_forest(edges: DataFrame, keys: tuple[str, ...]) -> bool:
    """Every node points at one root and no root points on (the loop's end test)."""
    ends = edges.select(*keys, F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(
        edges.select(*keys, F.col("v"), F.lit(0), F.lit(1)))
    loose = ends.groupBy(*keys, "node").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return loose.filter("out > 1 or (out = 1 and root = 1)").limit(1).count() == 0


def star_labels(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(keys, u, v)``: every node with an edge, and the least node it reaches."""
    current = edges
    while True:
        current = cut_lineage(_small_star(_large_star(current, keys), keys))
        if _is_star_forest(current, keys):
            return current


def label_runs(mask: DataFrame, connectivity: int = 8,
               keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Runs of the mask with ``comp_id``, the least run id of their component."""
    reach = 1 if connectivity == 8 else 0
    run = cut_lineage(_label_strips(runs(mask, keys), keys, reach))
    edges = cut_lineage(_touching(run, keys, reach).distinct())
    if edges.isEmpty():
        return run.withColumnRenamed("local", "comp_id")
    labels = star_labels(edges, keys).withColumnsRenamed({"u": "local", "v": "low"})
    return run.join(labels, [*keys, "local"], "left").withColumn(
        "comp_id", F.coalesce("low", "local")
    ).drop("low", "local")


def components(mask: DataFrame, connectivity: int = 8,
               keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """One row per component: ``comp_id, area, x0, y0, x1, y1``."""
    labelled = label_runs(mask, connectivity, keys)
    return component_stats(labelled, keys)


def component_stats(labelled: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return labelled.groupBy(*keys, "comp_id").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("area"),
        F.min("x0").alias("x0"), F.min("y").alias("y0"),
        F.max("x1").alias("x1"), F.max("y").alias("y1"),
    )


def component_pixels(labelled: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Labelled runs back to pixels ``(keys, x, y, comp_id)``."""
    return labelled.select(
        *keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y", "comp_id"
    )


def border_connected(pixels: DataFrame, near: str, out: str) -> DataFrame:
    """Mark dense-raster pixels with ``near`` set that reach the border 4-connectedly."""
    marked = pixels.filter(F.col(near))
    labelled = label_runs(marked.select("image_id", "x", "y"), 4)
    sized = labelled.join(pixels.groupBy("image_id").agg(
        F.first("w").alias("w"), F.first("h").alias("h")), "image_id")
    touching = (
        sized.filter("x0 = 0 or y = 0 or x1 = w - 1 or y = h - 1")
        .select("image_id", "comp_id").distinct()
    )
    reached = component_pixels(labelled.join(touching, ["image_id", "comp_id"], "left_semi"))
    reached = reached.select("image_id", "x", "y", F.lit(True).alias(out))
    return pixels.join(reached, ["image_id", "x", "y"], "left").withColumn(
        out, F.coalesce(out, F.lit(False))
    )


def nesting(pixels: DataFrame, content: str = "content") -> DataFrame:
    """Components of the content with the hole each lies in: ``component_stats`` and ``hole``, NULL outside.

    ``pixels`` is a dense raster. Content is 8-connected, background 4-connected; background that
    reaches the border is outside, any other is a hole. The pixel above a component's first pixel
    belongs to the background around it, so one lookup per component tells what it lies in. Images with a
    single component have no nesting, and their background is not labelled.
    """
    comps = cut_lineage(components(pixels.filter(content).select("image_id", "x", "y"), 8))
    several = comps.groupBy("image_id").agg(F.count("*").alias("n")).filter("n > 1").select("image_id")
    empty = pixels.filter(~F.col(content)).join(several, "image_id", "left_semi")
    back = label_runs(empty.select("image_id", "x", "y"), 4)
    size = empty.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    holes = component_stats(back).join(size, "image_id").filter(
        "x0 > 0 and y0 > 0 and x1 < w - 1 and y1 < h - 1").select("image_id", F.col("comp_id").alias("hole"))
    inner = back.join(holes.withColumnRenamed("hole", "comp_id"), ["image_id", "comp_id"], "left_semi").select(
        "image_id", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("comp_id").alias("hole"),
        F.explode(F.sequence(F.floor(F.col("x0") / BUCKET).cast("int"), F.floor(F.col("x1") / BUCKET).cast("int"))).alias("bucket"))
    first_x = (F.col("comp_id") % (1 << 20)).cast("int")  # a component's id is its first run's
    at = comps.select("image_id", "comp_id", (F.col("y0") - 1).alias("y"), first_x.alias("px"),
                      F.floor(first_x / BUCKET).cast("int").alias("bucket"))
    held = at.join(inner, ["image_id", "y", "bucket"]).filter("px between b0 and b1").select("image_id", "comp_id", "hole")
    return comps.join(held, ["image_id", "comp_id"], "left")


def objects_summary(comps: DataFrame, object_area: int, isolated_area: int,
                    micro_area: int) -> DataFrame:
    """Component counts and the smallest area, per image."""
    tally = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return comps.groupBy("image_id").agg(
        F.count("*").alias("n_components"),
        tally(F.col("area") >= object_area).alias("n_objects"),
        tally(F.col("area") <= isolated_area).alias("n_isolated"),
        tally(F.col("area") < micro_area).alias("n_micro"),
        F.min("area").alias("smallest_area"),
    )


def min_hole(pixels: DataFrame, content: str = "content") -> DataFrame:
    """Smallest enclosed background component (8-connected) per image."""
    background = pixels.filter(~F.col(content)).select("image_id", "x", "y", "w", "h")
    comps = components(background.select("image_id", "x", "y"), 8)
    size = pixels.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    inner = comps.join(size, "image_id").filter(
        "x0 > 0 and y0 > 0 and x1 < w - 1 and y1 < h - 1"
    )
    return inner.groupBy("image_id").agg(F.min("area").alias("min_hole_px"))
