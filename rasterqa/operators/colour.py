"""Colour summaries: dominant buckets, palettes, names and k-means groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterqa.functions.numbers import fixed, half_even
from rasterqa.session import cut_lineage

#: Distinct colours of an image that is grouped inside one task, at most.
WHOLE_COLOURS = 4096
#: Rows that are gathered before images are grouped.
TASK_ROWS = 1 << 16


def bucket_counts(pixels: DataFrame, step: int, content: str = "content",
                  keys=("image_id",)) -> DataFrame:
    """Content pixels per colour bucket of the given width."""
    cell = lambda c: (F.floor(F.col(c) / step) * step).cast("int").alias(c)
    return (
        pixels.filter(F.col(content))
        .groupBy(*keys, cell("r"), cell("g"), cell("b"))
        .agg(F.count("*").alias("n"))
    )


def dominant_colours(pixels: DataFrame, n: int = 5, step: int = 24,
                     content: str = "content", keys=("image_id",)) -> DataFrame:
    """The ``n`` commonest buckets per image, with rank and share of the content."""
    counts = bucket_counts(pixels, step, content, keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("r"), F.desc("g"), F.desc("b"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = counts.select("*", F.row_number().over(order).alias("rank"), total.alias("total"))
    return ranked.filter(F.col("rank") <= n).select(
        *keys, "rank", "r", "g", "b", "n",
        half_even(F.col("n") / F.col("total"), 3).alias("share"),
    )


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def palette_profile(pixels: DataFrame, step: int = 32, top: int = 8,
                    content: str = "content") -> DataFrame:
    """Number of colours after fixed bucketing, and the commonest with their percent."""
    ranked = dominant_colours(pixels, 1 << 30, step, content)
    entry = F.concat(hex_colour(F.col("r"), F.col("g"), F.col("b")), F.lit(" "),
                     fixed(F.col("pct"), 1), F.lit("%"))
    total = F.sum("n").over(Window.partitionBy("image_id"))
    with_pct = ranked.withColumn("pct", half_even(F.col("n") * 100.0 / total, 1))
    return with_pct.groupBy("image_id").agg(
        F.count("*").alias("colour_count"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", entry.alias("t"))))),
                lambda s: s["t"],
            ), ", ",
        ).alias("top_colours"),
    )


def colour_name(r: Column, g: Column, b: Column) -> Column:
    """Short human name of a swatch."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    hue = (
        F.when(
            (r >= g) & (r >= b),
            F.when((g > 150) & (b < 120), F.when(g > 200, "yellow").otherwise("orange"))
            .when((g > 60) & (b < g), "brown")
            .otherwise("red"),
        )
        .when((g >= r) & (g >= b), F.when(r > 150, "yellow-green").otherwise("green"))
        .otherwise(F.when(b > g, "blue").otherwise("purple"))
    )
    tone = F.when(hi < 110, "dark ").when(lo > 150, "light ").otherwise("")
    text = F.concat(tone, hue)
    named = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 40))
    grey = (
        F.when(hi > 220, "White / light grey").when(hi < 45, "Black")
        .when(hi < 110, "Dark grey").otherwise("Grey")
    )
    return F.when(hi - lo < 25, grey).otherwise(named)


def nearest(p: np.ndarray, centres: np.ndarray, m: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of its image for every colour, the first of equally near ones, and its
    squared distance."""
    group, least = np.zeros(len(p), np.int64), np.full(len(p), np.inf)
    for j in range(centres.shape[1]):
        d = p - centres[image, j]
        gap = np.where(j < m[image], d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2], np.inf)
        group, least = np.where(gap < least, j, group), np.minimum(gap, least)
    return group, least


def grouped_colours(image: np.ndarray, n: np.ndarray, p: np.ndarray, k_min: int, k_max: int, rounds: int):
    """k-means of many images side by side. ``image`` numbers them from 0 upwards, ``p`` are colours, ``n`` their
    pixels. Returns the group of each colour and the centres of each image."""
    first = np.flatnonzero(np.diff(image, prepend=-1))
    colours = np.diff(np.append(first, len(image)))
    k = np.maximum(np.where(colours >= k_min, k_min, 1), np.minimum(k_max, colours))
    rgb = (p[:, 0] << 16) | (p[:, 1] << 8) | p[:, 2]
    point = lambda code: np.stack([(code >> 16) & 255, (code >> 8) & 255, code & 255], 1).astype(float)
    centres, m = np.zeros((len(first), k_max, 3)), np.ones(len(first), np.int64)
    centres[:, 0] = point(np.maximum.reduceat((n << 24) | rgb, first))
    for _ in range(k_max - 1):
        far = np.maximum.reduceat((nearest(p, centres, m, image)[1].astype(np.int64) << 24) | rgb, first)
        on = np.flatnonzero((m < k) & (far >> 24 > 0))
        centres[on, m[on]] = point(far[on])
        m[on] += 1
    open_ = np.ones(len(first), bool)  # images with a centre that still moves
    for _ in range(rounds):
        rows = np.flatnonzero(open_[image])
        if not len(rows):
            break
        cell = image[rows] * k_max + nearest(p[rows], centres, m, image[rows])[0]
        size = np.bincount(cell, n[rows], len(first) * k_max)
        total = np.stack([np.bincount(cell, p[rows, c] * n[rows], len(size)) for c in range(3)], 1)
        new = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres.reshape(-1, 3)).reshape(centres.shape)
        d = new - centres
        shift = (d[:, :, 0] * d[:, :, 0] + d[:, :, 1] * d[:, :, 1] + d[:, :, 2] * d[:, :, 2]).max(axis=1)
        centres[open_] = new[open_]
        open_ &= shift > 1.0
    return nearest(p, centres, m, image)[0], centres


def whole_images(k_min: int, k_max: int, rounds: int):
    """Groups of images that lie whole in a task; rows come sorted by image."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = np.array(table.column("image_id"))
            n, *rgb = (np.array(table.column(c), np.int64) for c in ("n", "r", "g", "b"))
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            image = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
            group, centres = grouped_colours(image, n, np.stack(rgb, 1), k_min, k_max, rounds)
            size = np.bincount(image * k_max + group, n, len(first) * k_max).astype(np.int64)
            at = np.flatnonzero(size)
            c = centres.reshape(-1, 3)[at]
            yield pa.RecordBatch.from_arrays([
                table.column("image_id").combine_chunks().take(pa.array(first[at // k_max])), pa.array((at % k_max).astype(np.int32)),
                pa.array(size[at]), *map(pa.array, c.T.copy())], names=["image_id", "group", "n", "cr", "cg", "cb"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= TASK_ROWS:
                table = pa.Table.from_batches(held)
                ids = np.array(table.column("image_id"))
                cut = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if ids[0] != ids[-1] else 0
                if cut:
                    yield from out(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))
    return run


def colour_groups(pixels: DataFrame, k_min: int = 5, k_max: int = 8, rounds: int = 20,
                  min_pct: float = 0.5, whole: int = WHOLE_COLOURS) -> DataFrame:
    """k-means colour groups of every image at once.

    Works on distinct colours with their counts. Seeds are chosen farthest-first from
    the commonest colour, ties by colour, so runs repeat exactly. An image stops once no centre moves
    by more than 1. Images of at most ``whole`` colours are grouped many at a time inside tasks, in one
    pass; the colours of any other spread over tasks, with the same result.
    """
    base = cut_lineage(
        pixels.filter("a > 20").groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    )
    large = base.groupBy("image_id").agg(F.count("*").alias("colours")).filter(F.col("colours") > whole).select("image_id")
    small = base.join(F.broadcast(large), "image_id", "left_anti").select("image_id", "n", "r", "g", "b")
    kind = base.schema["image_id"].dataType.simpleString()
    final = small.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(
        whole_images(k_min, k_max, rounds), f"image_id {kind}, group int, n bigint, cr double, cg double, cb double").select(
        "image_id", "group", "n", F.struct(*[F.col(f"c{c}").alias(c) for c in "rgb"]).alias("c"))
    if not large.isEmpty():
        final = final.unionByName(spread_groups(base.join(F.broadcast(large), "image_id", "left_semi"), k_min, k_max, rounds))
    total = F.sum("n").over(Window.partitionBy("image_id"))
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "group")
    shared = final.withColumn("pct", half_even(F.col("n") * 100.0 / total, 1)).filter(F.col("pct") >= min_pct)
    chan = {c: F.floor(F.col("c")[c]).cast("int") for c in "rgb"}
    return shared.select(
        "image_id", F.row_number().over(order).alias("group_id"),
        *[v.alias(c) for c, v in chan.items()], "pct",
        colour_name(chan["r"], chan["g"], chan["b"]).alias("name"),
        hex_colour(chan["r"], chan["g"], chan["b"]).alias("hex"),
    )


def spread_groups(base: DataFrame, k_min: int, k_max: int, rounds: int) -> DataFrame:
    """Groups of images whose colours spread over tasks (Lloyd rounds as grouped sums).

    Centres per image are one array of at most ``k_max`` entries joined by ``image_id``, so colours are
    never multiplied by centres.
    """
    seen = base.groupBy("image_id").agg(
        F.count("*").alias("colours"), F.max(F.struct("n", "r", "g", "b")).alias("top"),
    )
    k = F.greatest(
        F.when(F.col("colours") >= k_min, F.lit(k_min)).otherwise(F.lit(1)),
        F.least(F.lit(k_max), "colours"),
    )
    point = lambda s: F.struct(*[s[c].cast("double").alias(c) for c in "rgb"])
    centres = seen.select(
        "image_id", k.cast("int").alias("k"), F.array(point(F.col("top"))).alias("centres"),
        F.lit(False).alias("settled"),
    )

    def square(p: Column, q: Column) -> Column:
        return sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "gb"), (p["r"] - q["r"]) * (p["r"] - q["r"]))

    here = F.struct("r", "g", "b")
    carried = [F.first(c).alias(c) for c in ("k", "centres", "settled")]

    for _ in range(k_max - 1):
        gap = F.array_min(F.transform("centres", lambda c: square(here, c)))
        far = base.join(centres, "image_id").groupBy("image_id").agg(
            *carried, F.max(F.struct(gap.alias("gap"), "r", "g", "b")).alias("far"))
        grown = F.when(
            (F.size("centres") < F.col("k")) & (F.col("far.gap") > 0),
            F.concat("centres", F.array(point(F.col("far")))),
        ).otherwise(F.col("centres"))
        centres = far.select("image_id", "k", grown.alias("centres"), "settled")
    centres = cut_lineage(centres)

    def assign(cs: DataFrame) -> DataFrame:
        gaps = F.transform("centres", lambda c, i: F.struct(square(here, c).alias("d"), i.alias("i")))
        return base.join(cs, "image_id").withColumn("group", F.array_min(gaps)["i"])

    for done in range(1, rounds + 1):
        means = assign(centres).groupBy("image_id", "group").agg(
            *carried, *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"])
        moved = means.groupBy("image_id").agg(
            *carried, F.map_from_entries(F.collect_list(F.struct("group", here))).alias("to"))
        new = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("to", i), c))
        shift = F.array_max(F.zip_with("centres", new, square))
        centres = moved.select(
            "image_id", "k", F.when(F.col("settled"), F.col("centres")).otherwise(new).alias("centres"),
            (F.col("settled") | (shift <= 1.0)).alias("settled"),
        )
        if done % 5 == 0:
            centres = cut_lineage(centres)
            if centres.filter(~F.col("settled")).limit(1).count() == 0:
                break
    centres = cut_lineage(centres)

    return assign(centres).groupBy("image_id", "group").agg(
        F.sum("n").alias("n"), F.first(F.col("centres")[F.col("group")]).alias("c")
    )
