"""Images of few pixels, scored whole inside a task.

An image of at most ``WHOLE_PIXELS`` pixels is one row: its size and its pixels, four bytes each. A task holds
images of one size as a stack, one array for each channel, and takes each step for all of them at once. Every step
follows the operator for images of any size that it is named after, value for value; larger images go there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterqa import dims
from rasterqa.operators import dct
from rasterqa.operators.components import _least_labels
from rasterqa.operators.envelopes import nearest_squares, ridge_thickness, row_gaps

#: Pixels of an image that is looked at inside one task, at most.
WHOLE_PIXELS = 1 << 16
#: Pixels of the frames that a task works on at once, about.
STACK_PIXELS = 1 << 19
SIDE = ("w int, h int, has_alpha boolean, mean_r int, mean_g int, mean_b int, box_aspect double, fill double, cx double, "
        "cy double, n_contours bigint, dominant array<struct<r: int, g: int, b: int>>, words array<bigint>, n_edges bigint, hits bigint")


def packed(pixels: DataFrame, whole: int = WHOLE_PIXELS) -> DataFrame:
    """``image_id, w, h, body``: one row per image, its pixels row by row as four bytes r, g, b, a. ``body`` is NULL
    for images of more than ``whole`` pixels and for those that are no dense raster of 8-bit values."""
    w, h, x, y = (F.col(c).cast("bigint") for c in "whxy")
    eight = lambda c: F.col(c).between(0, 255) & (F.col(c) == F.col(c).cast("int"))
    fits = (w * h <= whole) & (x >= 0) & (x < w) & (y >= 0) & (y < h) & eight("r") & eight("g") & eight("b") & eight("a")
    code = F.lit(0).cast("bigint")
    for c in "abgr":
        code = F.shiftleft(code, 8) + F.col(c).cast("bigint")
    rows = pixels.select("image_id", w.cast("int").alias("w"), h.cast("int").alias("h"), F.when(fits, F.shiftleft(y * w + x, 32) + code).alias("code"))
    got = rows.groupBy("image_id").agg(
        F.max("w").alias("w"), F.max("h").alias("h"), F.min("w").alias("w0"), F.min("h").alias("h0"), F.count("*").alias("n"),
        F.sort_array(F.collect_list("code")).alias("codes"))
    dense = (F.col("n") == F.col("w").cast("bigint") * F.col("h")) & (F.size("codes") == F.col("n")) & (F.col("w") == F.col("w0")) & (F.col("h") == F.col("h0"))
    kind = pixels.schema["image_id"].dataType.simpleString()
    return got.select("image_id", "w", "h", F.when(dense, F.col("codes")).alias("codes")).mapInArrow(
        _bodies, f"image_id {kind}, w int, h int, body binary")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = []
        for codes in batch.column("codes"):
            codes = None if not codes.is_valid else codes.values.to_numpy()
            whole = codes is not None and np.array_equal(codes >> 32, np.arange(len(codes)))
            bodies.append((codes & 0xFFFFFFFF).astype("<u4").tobytes() if whole else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "w", "h")), pa.array(bodies, pa.binary())], names=["image_id", "w", "h", "body"])


def channels(bodies: list[bytes], w: int, h: int) -> np.ndarray:
    """``[r, g, b, a]`` of images of one size, each ``n x h x w``."""
    flat = np.frombuffer(b"".join(bodies), np.uint8).reshape(len(bodies), h, w, 4)
    return np.ascontiguousarray(flat.transpose(3, 0, 1, 2)).astype(np.int64)


def by_shape(shapes: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Each distinct row of ``shapes`` with the places where it stands."""
    kinds, at = np.unique(shapes, axis=0, return_inverse=True)
    order = np.argsort(at.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(at.ravel(), minlength=len(kinds)))
    for kind, lo, hi in zip(kinds, np.concatenate(([0], ends[:-1])), ends):
        yield tuple(int(v) for v in kind), order[lo:hi]


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """The value ``dy`` rows and ``dx`` columns further on; ``fill`` outside the raster."""
    out = np.full_like(a, fill)
    h, w = a.shape[1:]
    if abs(dy) < h and abs(dx) < w:
        out[:, max(0, -dy):h - max(0, dy), max(0, -dx):w - max(0, dx)] = a[:, max(0, dy):h - max(0, -dy), max(0, dx):w - max(0, -dx)]
    return out


def labels(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """The first pixel of each pixel's component, as a place in the whole stack; -1 off the mask."""
    n, h, w = mask.shape
    place = np.full(mask.shape, -1)
    place[mask] = np.arange(mask.sum())
    u, v = [], []
    for dy, dx in [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * (connectivity == 8):
        a, b = place[:, :h - dy, max(0, -dx):w - max(0, dx)], place[:, dy:, max(0, dx):w - max(0, -dx)]
        on = (a >= 0) & (b >= 0)
        u.append(a[on])
        v.append(b[on])
    out = np.full(mask.shape, -1)
    out[mask] = np.flatnonzero(mask)[_least_labels(np.concatenate(u), np.concatenate(v), int(mask.sum()))]
    return out


def border(shape: tuple[int, ...]) -> np.ndarray:
    on = np.ones(shape[1:], bool)
    on[1:-1, 1:-1] = False
    return np.broadcast_to(on, shape)


def border_connected(near: np.ndarray) -> np.ndarray:
    """``components.border_connected``."""
    lab = labels(near, 4)
    reached = np.zeros(near.size, bool)
    reached[lab[border(near.shape) & near]] = True
    return near & reached[lab]


def colour_distance(px: np.ndarray, bg: np.ndarray) -> np.ndarray:
    """``masks.background_distance``; ``bg`` has one colour per image."""
    d = px[:3] - bg.T[:, :, None, None]
    return np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def content_connected(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``transforms.content_mask_connected``: has_alpha per image and content."""
    has_alpha = (px[3] < 255).any(axis=(1, 2))
    corners = np.sort(px[:3][:, :, [0, 0, -1, -1], [0, -1, 0, -1]], axis=2)
    bg = ((corners[:, :, 1] + corners[:, :, 2]) / 2).T
    clear = has_alpha[:, None, None]
    near = ~clear & (colour_distance(px, bg) <= 40.0)
    return has_alpha, np.where(clear, px[3] > 128, ~border_connected(near))


def boxes(on: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last column and row with a mark, and whether there is any."""
    cols, rows = on.any(axis=1), on.any(axis=2)
    h, w = on.shape[1:]
    return cols.argmax(1), w - 1 - cols[:, ::-1].argmax(1), rows.argmax(1), h - 1 - rows[:, ::-1].argmax(1), cols.any(axis=1)


def component_table(lab: np.ndarray) -> tuple[np.ndarray, ...]:
    """First pixel, image, area and box (x0, y0, x1, y1) of each component."""
    n, h, w = lab.shape
    at = np.flatnonzero(lab.ravel() >= 0)
    first, which = np.unique(lab.ravel()[at], return_inverse=True)
    x, y = at % w, at // w % h
    x0, y0, x1, y1 = np.full(len(first), w), np.full(len(first), h), np.full(len(first), -1), np.full(len(first), -1)
    np.minimum.at(x0, which, x), np.minimum.at(y0, which, y), np.maximum.at(x1, which, x), np.maximum.at(y1, which, y)
    return first, first // (h * w), np.bincount(which, minlength=len(first)), x0, y0, x1, y1


def contours(content: np.ndarray) -> np.ndarray:
    """``n_contours`` of ``metrics.contour_features`` over ``components.nesting``."""
    n, h, w = content.shape
    first, image, area = component_table(labels(content, 8))[:3]
    back = labels(~content, 4)
    b_first, _, _, x0, y0, x1, y1 = component_table(back)
    hole = np.zeros(content.size, bool)
    hole[b_first[(x0 > 0) & (y0 > 0) & (x1 < w - 1) & (y1 < h - 1)]] = True
    above = np.where(first // w % h > 0, back.ravel()[np.maximum(first - w, 0)], -1)
    several = np.bincount(image, minlength=n)[image] > 1
    inner = several & (above >= 0) & hole[np.maximum(above, 0)]
    total = np.bincount(image, area, n)
    outer = np.where(inner, 0, area)
    return np.bincount(image, outer > total[image] * 0.005, n).astype(np.int64)


def dominant(px: np.ndarray, content: np.ndarray, n_top: int = 5, step: int = 24) -> list[list[dict]]:
    """The commonest colour buckets of ``colour.dominant_colours`` in the order of their rank."""
    n = len(content)
    image = np.nonzero(content)[0]
    r, g, b = (px[c][content] // step for c in range(3))
    code, count = np.unique((image << 24) | (r << 16) | (g << 8) | b, return_counts=True)
    order = np.lexsort((-(code & 0xFFFFFF), -count, code >> 24))
    image, code = (code >> 24)[order], code[order]
    first = np.searchsorted(image, np.arange(n))
    rank = np.arange(len(image)) - first[image]
    out: list[list[dict]] = [[] for _ in range(n)]
    for i in np.flatnonzero(rank < n_top):
        c = int(code[i])
        out[image[i]].append({"r": (c >> 16 & 255) * step, "g": (c >> 8 & 255) * step, "b": (c & 255) * step})
    return out


def features(px: np.ndarray, has_alpha: np.ndarray, content: np.ndarray) -> dict[str, list]:
    """The columns of ``compare.image_features`` that scores read."""
    n, h, w = content.shape
    x0, x1, y0, y1, some = boxes(content)
    count = content.sum(axis=(1, 2))
    safe = np.maximum(count, 1)
    bw, bh = x1 - x0 + 1, y1 - y0 + 1
    mean = lambda v: np.where(some, (v * content).sum(axis=(1, 2)) / safe, 0.0)
    mx, my = mean(np.arange(w)[None, None, :]), mean(np.arange(h)[None, :, None])
    rgb = [np.rint(mean(px[c])).astype(np.int64) for c in range(3)]
    return {"w": [w] * n, "h": [h] * n, "has_alpha": has_alpha.tolist(), "mean_r": rgb[0].tolist(), "mean_g": rgb[1].tolist(), "mean_b": rgb[2].tolist(),
            "box_aspect": np.where(some, bw / bh, w / h).tolist(), "fill": np.where(some, np.minimum(1.0, count / (bw * bh)), 1.0).tolist(),
            "cx": np.where(some, (mx - x0) / bw, 0.5).tolist(), "cy": np.where(some, (my - y0) / bh, 0.5).tolist(),
            "n_contours": contours(content).tolist(), "dominant": dominant(px, content)}


def levels(total: np.ndarray, weight: float) -> np.ndarray:
    return np.rint(np.round(total / weight, 6))


def fit_view(grey: np.ndarray, mask: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """``transforms.fit_view`` of a stack: area-weighted grey, nearest mask. Sums are whole numbers."""
    old_h, old_w = grey.shape[1:]
    if (old_w, old_h) == (w, h):
        return grey, mask
    wide = np.einsum("nyx,cx->nyc", grey, dct.overlaps(old_w, w))
    total = np.einsum("nyc,ry->nrc", wide, dct.overlaps(old_h, h))
    near = mask[:, (np.arange(h) * old_h // h)[:, None], (np.arange(w) * old_w // w)[None, :]]
    return levels(total, float(old_w * old_h)), near


def views(px: np.ndarray, content: np.ndarray, long_side: int, pad: int = dims.COMPARE_PAD) -> list[tuple[np.ndarray, np.ndarray]]:
    """``transforms.neutral_grey``: grey and content of each image."""
    n, h, w = content.shape
    share = px[3] / 255.0
    flat = [np.floor(np.where(content, px[c] * share + dims.NEUTRAL_GREY * (1 - share), float(dims.NEUTRAL_GREY))) for c in range(3)]
    grey = np.rint((flat[0] * 299 + flat[1] * 587 + flat[2] * 114) / 1000)
    x0, x1, y0, y1, some = boxes(content)
    x0, y0 = np.where(some, x0, 0), np.where(some, y0, 0)
    cw, ch = np.where(some, x1 - x0 + 1, w), np.where(some, y1 - y0 + 1, h)
    out: list = [None] * n
    for (bw, bh), at in by_shape(np.stack([cw, ch], 1)):
        rows, cols = y0[at][:, None, None] + np.arange(bh)[None, :, None], x0[at][:, None, None] + np.arange(bw)[None, None, :]
        cut = lambda v: v[at[:, None, None], rows, cols]
        scale = long_side / max(bw, bh)
        g, c = fit_view(cut(grey), cut(content), max(1, int(np.rint(bw * scale))), max(1, int(np.rint(bh * scale))))
        edge = ((0, 0), (pad, pad), (pad, pad))
        g, c = np.pad(g, edge, constant_values=float(dims.NEUTRAL_GREY)), np.pad(c, edge)
        for k, i in enumerate(at):
            out[i] = (g[k], c[k])
    return out


def separable(v: np.ndarray, row_taps: list[float], col_taps: list[float]) -> np.ndarray:
    """``kernels.separable``, terms added in its order."""
    reach = len(row_taps) // 2
    h, w = v.shape[1:]
    v = np.pad(v, ((0, 0), (reach, reach), (reach, reach)), mode="reflect")
    add = lambda terms: sum(terms[1:], terms[0])
    v = add([t * v[:, :, i:i + w] for i, t in enumerate(row_taps) if t])
    return add([t * v[:, i:i + h, :] for i, t in enumerate(col_taps) if t])


def edge_map(level: np.ndarray, low: float = 40.0, high: float = 110.0) -> np.ndarray:
    """``compare.frame_edges`` of one side."""
    soft, slope, across = [0.25, 0.5, 0.25], [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0]
    blur = np.rint(separable(level, soft, soft))
    gx, gy = separable(blur, slope, across), separable(blur, across, slope)
    ax, ay = np.abs(gx), np.abs(gy)
    m = ax + ay
    at = lambda dy, dx: shifted(m, dy, dx, 0.0)
    ridge = np.select(
        [ay < ax * math.tan(math.pi / 8), ay > ax * math.tan(3 * math.pi / 8), (gx < 0) == (gy < 0)],
        [(m > at(0, -1)) & (m >= at(0, 1)), (m > at(-1, 0)) & (m >= at(1, 0)), (m > at(-1, -1)) & (m > at(1, 1))],
        (m > at(-1, 1)) & (m > at(1, -1)))
    weak = ridge & (m > low)
    lab = labels(weak, 8)
    alive = np.zeros(weak.size, bool)
    alive[lab[weak & (m > high)]] = True
    return weak & alive[lab]


def near_edges(edge: np.ndarray, reach: int = dims.EDGE_TOLERANCE_PX) -> np.ndarray:
    out = np.zeros_like(edge)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if dx * dx + dy * dy <= reach * reach:
                out |= shifted(edge, dy, dx, False)
    return out


def ssim(o: np.ndarray, g: np.ndarray, region: np.ndarray, taps: list[float], reach: int = 4) -> np.ndarray:
    """``compare.ssim`` of a stack of frames."""
    mo, mg, oo, gg, og = (separable(v, taps, taps) for v in (o, g, o * o, g * g, o * g))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    cov = og - mo * mg
    local = ((2 * mo * mg + c1) * (2 * cov + c2)) / ((mo * mo + mg * mg + c1) * ((oo - mo * mo) + (gg - mg * mg) + c2))
    near = region
    for axis in (1, 2):
        grown = near
        for d in range(1, reach + 1):
            for s in (d, -d):
                grown = grown | shifted(near, *((s, 0) if axis == 1 else (0, s)), False)
        near = grown
    n = near.sum(axis=(1, 2))
    mean = np.where(n > 0, (local * near).sum(axis=(1, 2)) / np.maximum(n, 1), local.mean(axis=(1, 2)))
    return np.maximum(0.0, np.minimum(1.0, mean))


def hash_words(grey: np.ndarray, size: int = 64, low: int = 16) -> np.ndarray:
    """``compare.phash256`` of a stack."""
    n, h, w = grey.shape
    down, right, wave = dct.overlaps(h, size), dct.overlaps(w, size), dct.waves(size, low, False)
    square = levels(np.einsum("nyc,ry->nrc", np.einsum("nyx,cx->nyc", grey, right), down), float(w * h))
    found = np.round(np.einsum("nkc,lc->nkl", np.einsum("kr,nrc->nkc", wave, square), wave).reshape(n, low * low), 6)
    bits = found > np.round(np.median(found, axis=1), 6)[:, None]
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def scored(long_side: int, taps: list[float]):
    """Features, hashes, edges and structure of pairs whose images lie in the rows, many pairs at a time."""
    side = long_side + 2 * dims.COMPARE_PAD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                most = max(1, STACK_PIXELS // (side * side))
                size = np.maximum.accumulate(np.maximum(*(np.array(batch.column(f"{s}_w").slice(at, most)) * np.array(batch.column(f"{s}_h").slice(at, most)) for s in "og")))
                most = max(1, int((size * np.arange(1, len(size) + 1) <= STACK_PIXELS).sum()))
                yield slab(batch.slice(at, most))
                at += most

    def slab(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        column = lambda c: batch.column(f"o_{c}").to_pylist() + batch.column(f"g_{c}").to_pylist()
        ws, hs, bodies = np.array(column("w")), np.array(column("h")), column("body")
        got: list[dict] = [{} for _ in range(2 * n)]
        seen: list = [None] * (2 * n)
        for (w, h), at in by_shape(np.stack([ws, hs], 1)):
            px = channels([bodies[i] for i in at], w, h)
            has_alpha, content = content_connected(px)
            table = features(px, has_alpha, content)
            for k, (i, view) in enumerate(zip(at, views(px, content, long_side))):
                got[i] = {c: v[k] for c, v in table.items()}
                seen[i] = view
        structure = np.zeros(n)
        for (ow, oh, gw, gh), at in by_shape(np.array([[*seen[i][0].shape[::-1], *seen[n + i][0].shape[::-1]] for i in range(n)])):
            o, on = (np.stack([seen[i][k] for i in at]) for k in (0, 1))
            g, gn = (np.stack([seen[n + i][k] for i in at]) for k in (0, 1))
            scale = min(ow / gw, oh / gh)
            fw, fh = (gw, gh) if (ow, oh) == (gw, gh) else (max(1, int(np.rint(gw * scale))), max(1, int(np.rint(gh * scale))))
            g, gn = fit_view(g, gn, fw, fh)
            dx, dy = (ow - fw) // 2, (oh - fh) // 2
            x0, y0, x1, y1 = max(dx, 0), max(dy, 0), min(dx + fw, ow), min(dy + fh, oh)
            framed, region = np.full(o.shape, float(dims.NEUTRAL_GREY)), on.copy()
            framed[:, y0:y1, x0:x1] = g[:, y0 - dy:y1 - dy, x0 - dx:x1 - dx]
            region[:, y0:y1, x0:x1] |= gn[:, y0 - dy:y1 - dy, x0 - dx:x1 - dx]
            structure[at] = ssim(o, framed, region, taps)
            eo, eg = edge_map(o), edge_map(framed)
            for grey, edge, other, shift in ((o, eo, eg, 0), (framed, eg, eo, n)):
                words, count, hit = hash_words(grey), edge.sum(axis=(1, 2)), (edge & near_edges(other)).sum(axis=(1, 2))
                for k, i in enumerate(at):
                    got[shift + i] |= {"words": words[k].tolist(), "n_edges": int(count[k]), "hits": int(hit[k])}
        kind = pa.struct([
            *((c, pa.int32()) for c in ("w", "h")), ("has_alpha", pa.bool_()), *((f"mean_{c}", pa.int32()) for c in "rgb"),
            *((c, pa.float64()) for c in ("box_aspect", "fill", "cx", "cy")), ("n_contours", pa.int64()),
            ("dominant", pa.list_(pa.struct([(c, pa.int32()) for c in "rgb"]))), ("words", pa.list_(pa.int64())), ("n_edges", pa.int64()), ("hits", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("pair_id", "original_id", "generated_id")), pa.array(got[:n], kind), pa.array(got[n:], kind), pa.array(structure)],
            names=["pair_id", "original_id", "generated_id", "o", "g", "ssim"])
    return run


def pair_figures(both: DataFrame, long_side: int, taps: list[float]) -> DataFrame:
    """``pair_id, original_id, generated_id, ssim`` and for both sides, prefixed ``o_`` and ``g_``, what the scores are
    made of. ``both`` has ``w, h, body`` of both sides."""
    rows = both.select("pair_id", "original_id", "generated_id", *[f"{s}_{c}" for s in "og" for c in ("w", "h", "body")])
    keys = [rows.schema[c] for c in ("pair_id", "original_id", "generated_id")]
    kind = T.StructType([*keys, *(T.StructField(s, T._parse_datatype_string(SIDE)) for s in "og"),
                         T.StructField("ssim", T.DoubleType())])
    # a number of partitions that short rows don't shrink: the work is in the tasks
    dealt = rows.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = dealt.mapInArrow(scored(long_side, taps), kind)
    names = kind["o"].dataType.names
    return out.select("pair_id", "original_id", "generated_id", "ssim", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "og" for c in names])


def percentile(values: np.ndarray, share: float) -> float:
    """As Spark interpolates it."""
    v = np.sort(values)
    at = (len(v) - 1) * share
    lo, hi = math.floor(at), math.ceil(at)
    return float(v[lo]) if v[lo] == v[hi] else float((hi - at) * v[lo] + (at - lo) * v[hi])


def grown(v: np.ndarray, kernel: dict[int, int], pick, off) -> np.ndarray:
    """``kernels.morph`` with ``pick`` as maximum or minimum; ``off`` stands for what lies outside the raster."""
    out = None
    for dy, half in kernel.items():
        for dx in range(-half, half + 1):
            at = shifted(v, dy, dx, off)
            out = at if out is None else pick(out, at)
    return out


def near_squares(on: np.ndarray, bound: int) -> np.ndarray:
    """Squared distance to the nearest mark at most ``bound`` away, else infinite."""
    h, w = on.shape[1:]
    out = np.full(on.shape, np.inf)
    ys, xs = range(-min(bound, h - 1), min(bound, h - 1) + 1), range(-min(bound, w - 1), min(bound, w - 1) + 1)
    for square, dy, dx in sorted((dy * dy + dx * dx, dy, dx) for dy in ys for dx in xs):
        if square <= bound * bound:
            out[shifted(on, dy, dx, False) & (out == np.inf)] = square
    return out


def distances(on: np.ndarray) -> np.ndarray:
    """``kernels.distance_to``: to the nearest mark, infinite in an image without one."""
    n, h, w = on.shape
    gap = row_gaps(on.reshape(n * h, w)).astype(float).reshape(n, h, w)
    columns = (gap * gap).transpose(1, 0, 2).reshape(h, n * w)
    ys = np.repeat(np.arange(h, dtype=float)[:, None], n * w, axis=1)
    return np.sqrt(nearest_squares(columns, ys)).reshape(h, n, w).transpose(1, 0, 2)


def quality(px: np.ndarray, dpi: float) -> dict[str, list]:
    """``qa.qa_measurements`` of images of one size whose long side is no longer than an analysis copy's."""
    n, h, w = px.shape[1:]
    a, some_alpha = px[3], (px[3] < 250).any(axis=(1, 2))
    y, x = np.mgrid[:h, :w]
    weight = (x < 1).astype(int) + (x >= w - 1) + (y < 1) + (y >= h - 1)
    ring = np.repeat(np.arange(h * w), weight.ravel())
    far = colour_distance(px, np.median(px[:3].reshape(3, n, h * w)[:, :, ring], axis=2).T)
    content = np.where(some_alpha[:, None, None], a > 20, far > 32.0)
    count = content.sum(axis=(1, 2))
    x0, x1, y0, y1, some = boxes(content)
    share = lambda v: v.sum(axis=(1, 2)) / (h * w) * 100.0
    lo, hi = dims.SEMI_ALPHA
    margin = np.minimum.reduce([x0, y0, w - 1 - x1, h - 1 - y1]) * 100.0 / min(w, h)
    lum = (px[0] * 299 + px[1] * 587 + px[2] * 114) / 1000

    core = a >= 250
    disc = {dy: round(math.sqrt(4 - dy * dy)) for dy in range(-2, 3)}
    halo = grown(core, disc, np.logical_or, False) & ~core
    by_core = grown(np.where(core, lum, 0.0), disc, np.maximum, -np.inf)
    pale = halo & (a >= 32) & (a < 255) & (lum > 140) & (lum < 250) & (lum > by_core + 25)
    ring_px, pale_px = halo.sum(axis=(1, 2)), pale.sum(axis=(1, 2))
    halo_pct = np.where(ring_px == 0, 0.0, pale_px * 100.0 / np.maximum(ring_px, 1))

    ref = np.array([max(1.0, float(np.median(far[i][content[i]]))) if count[i] else 1.0 for i in range(n)])
    level = np.where(some_alpha[:, None, None], a, np.minimum(1.0, far / ref[:, None, None]) * 255.0)
    inside = level >= 128
    edge = inside & ~grown(inside, {-1: 0, 0: 1, 1: 0}, np.logical_and, True)
    clear, opaque = (np.sqrt(near_squares(v, 16)) for v in (level <= dims.EDGE_ALPHA[0], level >= dims.EDGE_ALPHA[1]))
    usable = edge & (opaque <= 16)
    soft = usable & ((clear == np.inf) | (clear + opaque - 1 > dims.EDGE_SOFT_PX))
    n_usable = usable.sum(axis=(1, 2))
    soft_pct = np.where(n_usable == 0, 0.0, soft.sum(axis=(1, 2)) * 100.0 / np.maximum(n_usable, 1))

    image = np.nonzero(content)[0]
    code = np.unique((image << 24) | (px[0][content] // 32 << 16) | (px[1][content] // 32 << 8) | (px[2][content] // 32))
    colours = np.bincount(code >> 24, minlength=n).astype(float)
    dark, black = np.zeros(n), np.zeros(n)
    for i in range(n):
        v = lum[i][content[i]] if count[i] else lum[i].ravel()
        dark[i], black[i] = (v < dims.BLACK_MIN_LUM).sum() / len(v) * 100.0, percentile(v, 0.01)

    lab = labels(content, 8)
    first, of, area, cx0, cy0, cx1, cy1 = component_table(lab)
    side = dims.STROKE_MIN_COMP_MM / 25.4 * dpi * 1.0
    big = area >= max(4.0, side * side)
    any_big = np.bincount(of, big, n) > 0
    kept = np.zeros(content.size, bool)
    kept[first[big | ~any_big[of]]] = True
    stroke = content & kept[lab]
    depth = distances(~stroke)
    depth = np.where(stroke, np.where(np.isfinite(depth), depth, float(max(w, h))), 0.0)
    thin = np.zeros(n)
    sx0, sx1, sy0, sy1, has = boxes(stroke)
    for i in np.flatnonzero(has):
        d = depth[i, sy0[i]:sy1[i] + 1, sx0[i]:sx1[i] + 1]
        thin[i] = max(1.0, float(np.percentile(2 * ridge_thickness(d, dims.STROKE_LONG_SIDE) - 1, 5)))
    tall, wide, speck = cy1 - cy0 + 1, cx1 - cx0 + 1, dims.FEATURE_SPECK_MM / 25.4 * dpi
    ok = (tall >= 3) & (wide >= 3) & (area >= 12) & ((tall >= speck) | (wide >= speck))
    feature = np.zeros(n)
    for i in np.unique(of[ok]):
        feature[i] = percentile(tall[ok & (of == i)], 0.1)

    flat = np.floor(np.minimum(255.0, np.maximum(0.0, lum)))
    gx, gy = separable(flat, [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0]), separable(flat, [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0])
    mag = np.sqrt(gx * gx + gy * gy)
    smooth = (content & (mag > 3) & (mag < 25)).sum(axis=(1, 2))
    return {"has_alpha": some_alpha.tolist(), "n_content": count.tolist(), "clear_pct": share(a == 0).tolist(), "semi_pct": share((a >= lo) & (a <= hi)).tolist(),
            "margin_pct": np.where(some, margin, 100.0).tolist(), "dpi": [dpi] * n,
            "halo_pct": [v if t else None for v, t in zip(halo_pct.tolist(), some_alpha)], "soft_edge_pct": soft_pct.tolist(),
            "colour_count": colours.tolist(), "dark_pct": dark.tolist(),
            "black_level": [b if d >= dims.BLACK_MIN_SHARE_PCT else None for b, d in zip(black.tolist(), dark)],
            "min_stroke_px": thin.tolist(), "min_feature_px": feature.tolist(),
            "gradient_pct": np.where(count > 0, smooth / np.maximum(count, 1) * 100.0, 0.0).tolist()}


QUALITY = {"has_alpha": pa.bool_(), "n_content": pa.int64(), **{c: pa.float64() for c in (
    "clear_pct", "semi_pct", "margin_pct", "dpi", "halo_pct", "soft_edge_pct", "colour_count", "dark_pct", "black_level",
    "min_stroke_px", "min_feature_px", "gradient_pct")}}


def measured(dpi: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws, hs = np.array(batch.column("w"), np.int64), np.array(batch.column("h"), np.int64)
            bodies, found = batch.column("body"), {c: [None] * batch.num_rows for c in QUALITY}
            for (w, h), at in by_shape(np.stack([ws, hs], 1)):
                some = max(1, STACK_PIXELS // (w * h))
                for lo in range(0, len(at), some):
                    part = at[lo:lo + some]
                    for c, values in quality(channels([bodies[int(i)].as_py() for i in part], w, h), dpi).items():
                        for i, v in zip(part, values):
                            found[c][i] = v
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "w", "h")), *(pa.array(found[c], k) for c, k in QUALITY.items())],
                                             names=["image_id", "w", "h", *QUALITY])
    return run


def measurements(images: DataFrame, dpi: float) -> DataFrame:
    """``qa.qa_measurements`` of packed images, without ``top_colours``."""
    kind = images.schema["image_id"].dataType.simpleString()
    names = {"bool": "boolean", "int64": "bigint", "double": "double"}
    dealt = images.select("image_id", "w", "h", "body").repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(measured(dpi), f"image_id {kind}, w int, h int, " + ", ".join(f"{c} {names[str(k)]}" for c, k in QUALITY.items()))
