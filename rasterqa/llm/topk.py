"""Exact top-k inner products: norm-sorted candidates, rotated partial sums, residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterqa.llm.common import partitions, saved

#: Rows that fit the rotation, those with the smallest ids' hashes. Any rotation gives the
#: same result; a fitted one prunes more.
FIT_ROWS = 4096
#: Queries of one block. A block is broadcast: 8 bytes a component.
QUERY_BLOCK = 4096
#: Candidate rows scored together.
TILE = 2048

FOUND = "query_id long, vec_id long, score long"


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x``: vectors with an id and no null or non-finite component, as floor(256 x)."""
    x = F.col(embedding)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return rows.filter(F.col(vec_id).isNotNull() & x.isNotNull() & ~odd).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("double")).alias("x"),
    )


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthonormal basis, widest direction first, from an SVD of at most ``FIT_ROWS`` rows."""
    fit = vectors.filter(F.size("x") == width).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS)
    rows = [r.x for r in fit.select("x").collect()]
    return np.linalg.svd(np.array(rows, float), full_matrices=True)[2].T if rows and width else np.eye(width)


def scan(queries, basis: np.ndarray, k: int, head: int):
    """Best ``k`` candidates of every query among the rows of a partition.

    Candidates come longest first. For a query q and a tile whose longest vector has
    length r, no score exceeds |q| r; once that is below q's k-th best so far, the
    rest of the partition can't change it. Inside a tile the sum of the first ``head``
    rotated components plus the product of the residual lengths bounds each score.
    Surviving pairs are scored with integers. Bounds are widened by a relative 1e-9.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        nq, width = q.shape
        qr = q @ basis
        q_head, q_rest, q_len = qr[:, :head], np.sqrt(np.maximum((qr[:, head:] ** 2).sum(1), 0)), np.sqrt((q ** 2).sum(1))
        best, best_id = np.full((nq, k), -np.inf), np.zeros((nq, k), np.int64)
        for batch in batches:
            lens = np.array(batch.column(1).value_lengths())
            pick = np.flatnonzero(lens == width)
            if not len(pick):
                continue
            vec = np.array(batch.column(0))[pick]
            flat = np.array(batch.column(1).flatten())
            x = flat.reshape(len(lens), width) if len(pick) == len(lens) else np.array(batch.column(1).take(pa.array(pick)).flatten()).reshape(len(pick), width)
            for at in range(0, len(vec), TILE):
                c, c_id = x[at:at + TILE], vec[at:at + TILE]
                worst = best[:, -1]
                c_len = np.sqrt((c ** 2).sum(1))
                slack = 1e-9 * (1 + q_len * c_len.max())
                live = np.flatnonzero(q_len * c_len.max() + slack >= worst)
                if not len(live):
                    continue
                cr = c @ basis
                rest = np.sqrt(np.maximum((cr[:, head:] ** 2).sum(1), 0))
                bound = q_head[live] @ cr[:, :head].T + np.outer(q_rest[live], rest) + slack[live, None]
                need = bound >= worst[live, None]
                cols = np.flatnonzero(need.any(0))
                if not len(cols):
                    continue
                # whole numbers below 2**53: the products and sums are exact
                score = q[live] @ c[cols].T
                hit = need[:, cols] & (score >= worst[live, None]) & (ids[live][:, None] != c_id[cols][None, :])
                r, col = np.nonzero(hit)
                held_r, held_c = np.nonzero(best[live] > -np.inf)
                keep = ranked(
                    np.concatenate([live[held_r], live[r]]), np.concatenate([best[live][held_r, held_c], score[r, col]]),
                    np.concatenate([best_id[live][held_r, held_c], c_id[cols][col]]), k)
                best[live], best_id[live] = -np.inf, 0
                best[keep[0], keep[1]], best_id[keep[0], keep[1]] = keep[2], keep[3]
        row, col = np.nonzero(best > -np.inf)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best_id[row, col]), pa.array(best[row, col].astype(np.int64))],
                                             names=["query_id", "vec_id", "score"])
    return run


def ranked(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """Row, place, score and id of the k highest scores of each row, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    top = place < k
    return row[top], place[top], score[top], ids[top]


def top_k(rows: DataFrame, is_query: Column, k: int = 5, head: int | None = None,
          vec_id: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products.

    Components count as floor(256 x). Every row but the query's own id is a candidate;
    ties go to the smaller id. Vectors of a different length than the query's are no
    candidates of it. Queries go in blocks of ``query_block`` by hash, each broadcast
    and held against all rows, which lie in random partitions, longest first;
    each partition keeps k rows a query and a ranking by query merges them.

    Null ids, null vectors and vectors with a null or non-finite component take no part; repeated
    ids are candidates each, and one query; empty tables give no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = saved(usable(rows, vec_id, embedding).withColumn("norm", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))
    asked = vectors.filter(is_query).dropDuplicates(["vec_id"])
    parts = []
    for width, n in sorted((r[0], r[1]) for r in asked.groupBy(F.size("x")).count().collect()):
        blocks = -(-n // query_block)
        basis = rotation(vectors, width)
        mine = asked.filter(F.size("x") == width).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        spread = vectors.repartition(partitions(spark), F.xxhash64("vec_id", "x")).sortWithinPartitions(F.desc("norm"))
        for b in range(blocks):
            got = mine.filter(F.col("block") == b).select("vec_id", "x").toArrow()
            if not got.num_rows:
                continue
            q = np.array(got.column("x").combine_chunks().flatten()).reshape(got.num_rows, width)
            sent = spark.sparkContext.broadcast((np.array(got.column("vec_id")), q))
            parts.append(spread.select("vec_id", "x").mapInArrow(scan(sent, basis, k, head or max(1, width // 4)), FOUND))
    if not parts:
        found = vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
