"""Row-order operators that do not put a hot key's whole history in one task.

Keys are cut into time slots. Work inside a slot is an ordinary window; what crosses a
slot edge comes from a one-row-per-slot summary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slot(ts: str, length: int) -> Column:
    return F.floor(F.col(ts) / length).cast("bigint")


def previous_row(df: DataFrame, key: str, order: list[str], payload: list[str], slot: int) -> DataFrame:
    """Add ``prev``, the payload of the row before in key order (NULL on the first)."""
    packed, place = F.struct(*payload), F.struct(*order)
    cut = df.withColumn("_slot", _slot(order[0], slot))
    last = cut.groupBy(key, "_slot").agg(F.max_by(packed, place).alias("_last"))
    edge = Window.partitionBy(key).orderBy("_slot")
    carried = last.select(key, "_slot", F.lag("_last").over(edge).alias("_before"))
    inside = Window.partitionBy(key, "_slot").orderBy(*order)
    return cut.withColumn("_lag", F.lag(packed).over(inside)).join(carried, [key, "_slot"]).select(
        *df.columns, F.coalesce("_lag", "_before").alias("prev"))


def running_sum(df: DataFrame, key: str | list[str], order: list[str], value: Column, out: str, slot: int) -> DataFrame:
    """Running total in key order: inside the slot, plus the totals of earlier slots."""
    keys = [key] if isinstance(key, str) else list(key)
    cut = df.withColumn("_slot", _slot(order[0], slot)).withColumn("_v", value)
    totals = cut.groupBy(*keys, "_slot").agg(F.sum("_v").alias("_t"))
    edge = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_slot", F.coalesce(F.sum("_t").over(edge), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("_run", F.sum("_v").over(inside)).join(offsets, [*keys, "_slot"])
    return summed.select(*df.columns, (F.col("_run") + F.col("_off")).alias(out))


def trailing_count(df: DataFrame, key: str, ts: str, window: int, out: str, slot: int) -> DataFrame:
    """Rows of the key in the ``window`` before each row, itself included.

    Rows near the end of a slot are also sent to the next one, as context only.
    """
    if slot < window:
        raise ValueError("slot must not be shorter than the window")
    own = _slot(ts, slot)
    late = F.floor((F.col(ts) + window) / slot).cast("bigint")
    wide = df.withColumn("_own", own).withColumn("_slot", F.explode(F.array_distinct(F.array(own, late))))
    near = Window.partitionBy(key, "_slot").orderBy(ts).rangeBetween(-window, 0)
    return wide.withColumn(out, F.count(F.lit(1)).over(near)).filter("_own = _slot").drop("_own", "_slot")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable, schema: str) -> DataFrame:
    """Stream each key's rows in order through ``fold`` (a mapInPandas function).

    Used where the next state needs the last one. Rows arrive sorted and in batches;
    ``fold`` keeps only its own small state between them, so memory does not grow with
    the key.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, schema)


def last_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Newest ``n`` rows per key. Spark trims each input partition to n rows per key
    before the shuffle, so a hot key sends n rows per task at most."""
    win = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(win)).filter(F.col("rn") <= n)
