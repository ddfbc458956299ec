"""Hashes of rasters from their low DCT frequencies, at the size of a small square.

One row per raster row goes through the first shuffle, one list of those per raster through the second;
the cells of the square are only made inside a task, so a raster that grows on the way is not shuffled large.
Rows wider than the square are cut down to its width before they are put together: a task holds a raster's
height times ``size`` values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=8)
def overlaps(length: int, size: int) -> np.ndarray:
    """Shared length of target cell (row) and source pixel (column), in units of 1/(length * size) of the axis."""
    cell, pos = np.arange(size)[:, None], np.arange(length)[None, :]
    return np.maximum(np.minimum((pos + 1) * size, (cell + 1) * length) - np.maximum(pos * size, cell * length), 0).astype(float)


def waves(size: int, low: int, orthonormal: bool) -> np.ndarray:
    k, p = np.arange(low)[:, None], np.arange(size)[None, :]
    out = np.cos((2 * p + 1) * np.pi * k / (2 * size))
    if orthonormal:
        out[0] *= np.sqrt(0.5)
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product without the linear algebra library, whose threads would fight over a task's one core."""
    return np.einsum("ij,jk->ik", a, b)


def narrowed(size: int):
    """Rows wider than ``size`` as ``size`` weighted sums with their weights; others pass as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w").to_numpy()
            if not (w > size).any():
                yield batch
                continue
            line = batch.column("line").to_pylist()
            for i in np.flatnonzero(w > size):
                x = np.array(line[i]["x"], int)
                part = overlaps(int(w[i]), size)[:, x]
                n = part.sum(1)
                on = np.flatnonzero(n)
                line[i] = {"y": line[i]["y"], "x": on, "v": np.einsum("ij,j->i", part, np.array(line[i]["v"], float))[on], "n": n[on]}
            at = batch.schema.get_field_index("line")
            yield batch.set_column(at, "line", pa.array(line, batch.schema.field(at).type))
    return run


def hashed(size: int, low: int, skip_first_row: bool):
    wave = waves(size, low, skip_first_row)
    pool = low if skip_first_row else 0

    def square(w: int, h: int, y: np.ndarray, x: np.ndarray, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Area-weighted mean of each cell as a whole level; cells without a pixel are 0."""
        total, weight = np.zeros((h, min(w, size))), np.zeros((h, min(w, size)))
        np.add.at(total, (y, x), v)
        np.add.at(weight, (y, x), n)
        down = overlaps(h, size)
        total, weight = times(down, total), times(down, weight)
        if w <= size:
            total, weight = times(total, overlaps(w, size).T), times(weight, overlaps(w, size).T)
        return np.rint(np.round(np.divide(total, weight, out=np.zeros_like(total), where=weight > 0), 6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column("lines")
            flat = lines.flatten()
            first = np.concatenate(([0], np.cumsum(lines.value_lengths().to_numpy())))
            x, v, n = (flat.field(c) for c in "xvn")
            start = np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy())))
            weights = np.concatenate(([0], np.cumsum(n.value_lengths().to_numpy())))
            y, x, v, n = flat.field("y").to_numpy(), x.flatten().to_numpy(), v.flatten().to_numpy(), n.flatten().to_numpy()
            ys = np.repeat(y, np.diff(start))
            found = np.empty((len(batch), low * low))
            for i, (w, h) in enumerate(zip(batch.column("w").to_pylist(), batch.column("h").to_pylist())):
                a, z = start[first[i]], start[first[i + 1]]
                own = n[weights[first[i]]:weights[first[i + 1]]] if w > size else np.ones(z - a)
                found[i] = times(times(wave, square(w, h, ys[a:z], x[a:z], v[a:z], own)), wave.T).ravel()
            keys = [c for c in batch.schema.names if c not in ("w", "h", "lines")]
            found = np.round(found, 6)
            bits = found > np.round(np.median(found[:, pool:], axis=1), 6)[:, None]
            per = low * low // 64
            words = np.packbits(bits[:, :per * 64], axis=1).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in keys), pa.array([(b + 48).tobytes().decode() for b in bits.astype(np.uint8)], pa.string()),
                pa.ListArray.from_arrays(np.arange(0, words.size + 1, per, dtype=np.int32), words.ravel())], names=[*keys, "hash_bits", "words"])
    return run


def hashes(grey: DataFrame, level: str, size: int, low: int, skip_first_row: bool, keys) -> DataFrame:
    """``hash_bits, words``: bits of the low block of the 2-D DCT-II of each raster at ``size x size`` whole levels.

    A bit is set where a coefficient exceeds the median (without the first row and orthonormal, or of all);
    both are compared to six decimals so the order of summing cannot flip one.
    """
    got = F.array_sort(F.collect_list(F.struct("x", F.coalesce(F.col(level).cast("double"), F.lit(0.0)).alias("v"))))
    rows = grey.groupBy(*keys, "w", "h", "y").agg(got.alias("got")).select(*keys, "w", "h", F.struct(
        F.col("y"), F.col("got.x").alias("x"), F.col("got.v").alias("v"), F.array().cast("array<double>").alias("n")).alias("line"))
    rows = rows.mapInArrow(narrowed(size), rows.schema)
    # a number of partitions that short rows don't shrink: the work is in the tasks
    dealt = rows.repartition(int(grey.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    whole = dealt.groupBy(*keys, "w", "h").agg(F.collect_list("line").alias("lines"))
    schema = T.StructType([*(grey.schema[k] for k in keys), T.StructField("hash_bits", T.StringType()),
                           T.StructField("words", T.ArrayType(T.LongType()))])
    return whole.mapInArrow(hashed(size, low, skip_first_row), schema)
