"""Array steps of exact distances: lower envelopes down raster columns, and stroke thickness.

Spark deals out columns (or whole analysis copies, which have a capped side) and these
functions run over many of them at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are gathered before columns are worked out together.
CELLS = 1 << 18


def nearest_squares(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``min over p of (y[q] - y[p])**2 + f[p]`` for each cell of each column of ``f``, in linear time.

    Down a column the parabolas over its cells form a lower envelope, kept as a stack of the cells
    that own a part of it and the places from which they do. All columns advance together.
    """
    h, n = f.shape
    owner, start = np.zeros((h, n), np.int32), np.zeros((h, n))
    top = np.full(n, -1)
    rise = f + y * y
    for q in range(h):
        new = todo = np.flatnonzero(np.isfinite(f[q]))
        since = np.full(n, -np.inf)
        while len(todo):
            todo = todo[top[todo] >= 0]
            if not len(todo):
                break
            p = owner[top[todo], todo]
            meet = (rise[q, todo] - rise[p, todo]) / (2 * (y[q, todo] - y[p, todo]))
            hidden = meet <= start[top[todo], todo]
            since[todo[~hidden]] = meet[~hidden]
            todo = todo[hidden]
            top[todo] -= 1
        top[new] += 1
        owner[top[new], new] = q
        start[top[new], new] = since[new]
    out = np.full((h, n), np.inf)
    on = np.flatnonzero(top >= 0)
    at = np.zeros(len(on), np.int64)
    for q in range(h):
        ahead = np.arange(len(on))
        while len(ahead):
            step = at[ahead] + 1
            ahead = ahead[step <= top[on[ahead]]]
            ahead = ahead[start[at[ahead] + 1, on[ahead]] < y[q, on[ahead]]]
            at[ahead] += 1
        p = owner[at, on]
        out[q, on] = (y[q, on] - y[p, on]) ** 2 + f[p, on]
    return out


def changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = column[1:], column[:-1]
    return np.array(pc.fill_null(pc.not_equal(a, b), False)) | np.array(pc.xor(pc.is_null(a), pc.is_null(b)))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of whole groups, ``least`` rows or more each but the last; rows come sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    rows = cut = 0  # held rows, and those before the last group, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        near = pa.Table.from_batches([*edge, batch])
        new = np.flatnonzero(np.logical_or.reduce([changes(near.column(k).combine_chunks()) for k in keys]))
        if len(new):
            cut = rows + int(new[-1]) + 1 - len(edge)
        held.append(batch)
        rows += batch.num_rows
        if cut and rows >= least:
            t = pa.Table.from_batches(held)
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            rows, cut = rows - cut, 0
    if rows:
        yield pa.Table.from_batches(held)


def column_pass(keys: list[str], gaps: dict[str, str]) -> Callable:
    """Rows come sorted by ``keys`` and y. ``gaps`` maps an output to the distance to the set within
    the cell's own raster row; null means none there."""
    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([changes(t.column(k).combine_chunks()) for k in keys])
        first = np.flatnonzero(new)
        height = np.diff(np.append(first, t.num_rows))
        ys = np.array(t.column("y").cast(pa.float64()))
        found = {out: np.empty(t.num_rows) for out in gaps}
        for h in np.unique(height):
            cells = first[height == h][None, :] + np.arange(h)[:, None]
            for out, gap in gaps.items():
                f = np.array(pc.fill_null(t.column(gap).cast(pa.float64()), np.inf))[cells]
                found[out][cells] = np.sqrt(nearest_squares(f * f, ys[cells]))
        for out, d in found.items():
            t = t.append_column(out, pa.array(d, mask=~np.isfinite(d)))
        yield from t.drop_columns(list(gaps.values())).combine_chunks().to_batches(max_chunksize=10_000)

    return lambda batches: (out for t in whole_groups(batches, keys, CELLS) for out in solve(t))


def radius_levels(dmax: float, side: int) -> list[float]:
    """Geometric disc radii 1, 1.5, ... below ``dmax``, closed by ``dmax`` itself (fixed values)."""
    levels, r = [], 1.0
    while r < min(side, dmax):
        levels.append(r)
        r = max(r + 0.5, r * 1.3)
    return [*levels, dmax]


def row_gaps(on: np.ndarray) -> np.ndarray:
    """Distance within the row to the nearest marked cell; infinite in a row without one."""
    x = np.arange(on.shape[1], dtype=np.float32)
    left = np.maximum.accumulate(np.where(on, x, -np.inf), axis=1)
    right = np.minimum.accumulate(np.where(on, x, np.inf)[:, ::-1], axis=1)[:, ::-1]
    return np.minimum(x - left, right - x)


def ridge_thickness(d: np.ndarray, side: int) -> np.ndarray:
    """For each ridge cell of a distance map the largest level whose disc fits the shape and covers it.

    Levels go from large to small and a cell leaves with the first that reaches it, so
    each level looks only at the cells it could still raise, within its own radius of its discs.
    """
    h, w = d.shape
    wide = np.pad(d, 1)
    peak = np.max([wide[i:i + h, j:j + w] for i in range(3) for j in range(3)], axis=0)
    ys, xs = np.nonzero((d > 0) & (d >= peak))
    thick, depth = np.zeros(len(ys)), d[ys, xs]
    left = np.arange(len(ys))
    for r in reversed(radius_levels(float(d.max()), side)) if len(ys) else []:
        thick[left[depth[left] >= r - 1e-3]] = r
        left = left[depth[left] < r - 1e-3]
        if not len(left):
            break
        seeds = d >= r - 1e-3
        rows, cols = np.flatnonzero(seeds.any(axis=1)), np.flatnonzero(seeds.any(axis=0))
        reach, span = r + 0.5, int(r + 0.5)
        y0, x0 = max(rows[0] - span, 0), max(cols[0] - span, 0)
        y1, x1 = min(rows[-1] + span + 1, h), min(cols[-1] + span + 1, w)
        near = left[(ys[left] >= y0) & (ys[left] < y1) & (xs[left] >= x0) & (xs[left] < x1)]
        gap = row_gaps(seeds[y0:y1, x0:x1])
        for dy in sorted(range(-span, span + 1), key=abs):
            if not len(near):
                break
            at = ys[near] + dy - y0
            ok = (at >= 0) & (at < y1 - y0)
            ok[ok] = gap[at[ok], xs[near[ok]] - x0] <= math.sqrt(reach * reach - dy * dy)
            thick[near[ok]] = r
            near = near[~ok]
        left = left[thick[left] == 0]
    return thick


def stroke_of_copies(side: int) -> Callable:
    """Thin end of the stroke widths of analysis copies, from their content cells ``(image_id, x, y, d)``
    in the order of ``image_id``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["image_id"], 1):
            first = np.flatnonzero(np.concatenate(([True], changes(t.column("image_id").combine_chunks()))))
            x, y, depth = (np.array(t.column(c)) for c in ("x", "y", "d"))
            thin = []
            for lo, hi in zip(first, [*first[1:], t.num_rows]):
                px, py = x[lo:hi] - x[lo:hi].min(), y[lo:hi] - y[lo:hi].min()
                d = np.zeros((py.max() + 1, px.max() + 1))
                d[py, px] = depth[lo:hi]
                thin.append(float(np.percentile(2 * ridge_thickness(d, side) - 1, 5)))
            ids = t.column("image_id").take(pa.array(first)).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(thin, pa.float64())], names=["image_id", "thin"])
    return run
