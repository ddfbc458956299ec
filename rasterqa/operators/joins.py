"""Join shapes Spark has no single operator for: band, as-of, first-match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], width: int) -> DataFrame:
    """Rows whose ``columns`` all lie within ``width`` of each other, per key.

    The first column is cut into cells of the band's width; the right side is sent to
    its own and both neighbouring cells, so the join is an equi-join on key and cell.
    """
    lead = columns[0]
    cell = lambda c: F.floor(F.col(c) / width).cast("bigint")
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    here = cell(f"_{lead}")
    spread = renamed.withColumn("_cell", F.explode(F.array(here - 1, here, here + 1)))
    hit = left.withColumn("_cell", cell(lead)).join(spread, [*keys, "_cell"])
    for c in columns:
        hit = hit.filter(F.abs(F.col(c) - F.col(f"_{c}")) <= width)
    return hit.drop("_cell", *[f"_{c}" for c in columns])


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
          payload: list[str], slot: int) -> DataFrame:
    """Latest ``right`` row per left row with ``right_ts <= left_ts`` (NULLs if none).

    Both sides are cut into time slots of length ``slot`` (same unit as the stamps).
    Within a slot the running last value decides; before it, the newest row of all
    earlier slots, found on the per-slot summary only. No window spans a whole key.
    """
    slot_of = lambda ts: F.floor(F.col(ts) / slot).cast("bigint")
    packed = F.struct(F.col(right_ts).alias("ts"), *payload)
    newest = (
        right.groupBy(key, slot_of(right_ts).alias("_slot")).agg(F.max_by(packed, F.col(right_ts)).alias("best"))
    )
    slots = left.select(key, slot_of(left_ts).alias("_slot")).distinct()
    order = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        slots.join(newest, [key, "_slot"], "full_outer")
        .withColumn("before", F.last("best", ignorenulls=True).over(order))
        .select(key, "_slot", "before")
    )
    events = left.select(
        key, slot_of(left_ts).alias("_slot"), F.col(left_ts).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(right.select(packed.alias("s")).schema["s"].dataType).alias("_row"),
        F.struct(*left.columns).alias("_left"),
    ).unionByName(right.select(
        key, slot_of(right_ts).alias("_slot"), F.col(right_ts).alias("_at"), F.lit(0).alias("_side"),
        packed.alias("_row"),
    ), allowMissingColumns=True)
    inside = Window.partitionBy(key, "_slot").orderBy("_at", "_side")
    seen = events.withColumn("_row", F.last("_row", ignorenulls=True).over(inside)).filter("_side = 1")
    return seen.join(carried, [key, "_slot"], "left").select(
        "_left.*", *[F.coalesce(F.col("_row")[c], F.col("before")[c]).alias(c) for c in payload],
        F.coalesce(F.col("_row")["ts"], F.col("before")["ts"]).alias(f"{right_ts}_used"),
    )


def first_match(matches: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Best match per key; candidates come from a small dimension, so groups stay small."""
    win = Window.partitionBy(*keys).orderBy(*order)
    return matches.withColumn("_rn", F.row_number().over(win)).filter("_rn = 1").drop("_rn")
