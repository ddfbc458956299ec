"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterqa.llm.common import WORD, saved

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Documents of one source are numbered inside slots, so that no task holds a whole source.
SLOTS = 64
#: Sizes within one band differ by a tenth at most; bands are sampled in turn.
BAND = 1.1
#: Steps of the offset that are tried, to meet the target of a short source.
TRIES = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size`` -> the same with ``target``.

    Sources in code point order, null last, weigh ``weights``, repeating, and share the
    sum of all sizes. A target stops at ``max_repeats`` times its source's size and the
    excess is shared again by weight until none is above: the fixed point is
    ``min(cap, level * weight)`` for one common level, which the sources ordered by
    ``cap / weight`` give in one pass. One row per source passes through one task.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    return (
        ranked.withColumn("level", level).withColumn("level", F.max(fits).over(every))
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))
    )


def random_offset(source: Column, seed: str, shift: Column) -> Column:
    """A number in [0, 1) from the seed and the source, moved on by ``shift`` modulo 1."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("="), source), F.lit("-")))
    drawn = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return drawn + shift - F.floor(drawn + shift)


def crossings(place: Column, rate: Column, offset: Column, most: int) -> Column:
    """Integers that the running sum crosses at the document in this place (from 1)."""
    upto = lambda i: F.floor(i * rate + offset)
    return F.least(upto(place) - upto(place - 1), F.lit(most))


def with_slot(d: DataFrame) -> DataFrame:
    """Key of the source (never null), size band, hash of the id and slot of each document."""
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10)
    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.log(F.lit(BAND))).cast("int")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return d.withColumns({"key": key, "band": band, "h": number.cast("long")}).withColumn("slot", (F.col("h") % SLOTS).cast("int"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix",
        doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs`` as struct ``doc`` with ``size, source_size, target, copies``; ``keep`` names the columns
    in ``doc`` (all), and only those are shuffled.

    Every document of a source expects ``target / source_size`` copies. Documents are
    lined up by size band, slot, size and id; running sums of the expected copies plus one
    random offset per source cross ``copies`` integers at each document. Neighbours in this
    order have like sizes, so a long source meets its target closely whatever the offset.
    For short ones the drawn offset is moved by the one of ``TRIES`` equal steps that
    takes the words nearest to the target.

    The running sum is a row number inside (source, band, slot) plus the counts of the
    slots before, so a source with a third of all rows spreads over all tasks. What the slots
    add is one row each, joined on the window's own keys: documents are shuffled once.

    Null or empty texts have size 0 and 0 copies; null sources form a source of their own; rows
    that repeat an id are documents of their own; an empty table gives no rows; other
    columns ride along in ``doc``.
    """
    thin = saved(with_slot(docs.select(
        F.col(source).alias("source"), F.col(doc_id).alias("id"), word_count(F.col(text)).alias("size"))))
    line_keys = ["key", "band", "slot"]
    counts = thin.groupBy("source", *line_keys).agg(F.count(F.when(F.col("size") > 0, 1)).alias("n"), F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy("band", "slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).select(*line_keys, "before")
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    targets = targets.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))).drop("source")
    plan = saved(slots.join(targets, "key"))

    def in_line(rows: DataFrame, plan: DataFrame) -> DataFrame:
        line = Window.partitionBy(*line_keys).orderBy(F.col("size") == 0, "size", "h", "id")
        return rows.withColumn("at", F.row_number().over(line)).join(plan, line_keys).withColumns({
            "place": F.col("before") + F.col("at"),
            "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)})

    def copies(shift: Column) -> Column:
        n = crossings(F.col("place"), F.col("rate"), random_offset(F.col("source"), seed, shift), max_repeats)
        return F.when(F.col("size") > 0, n).otherwise(0).cast("long")

    taken = in_line(thin, plan).groupBy("key").agg(
        F.first("target").alias("goal"), *[F.sum(F.col("size") * copies(F.lit(t / TRIES))).alias(f"t{t}") for t in range(TRIES)])
    miss = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{t}") - F.col("goal")).alias("miss"), F.lit(t / TRIES).alias("shift")) for t in range(TRIES)]))
    shifts = taken.select("key", miss["shift"].alias("shift"))

    whole = with_slot(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), F.col(source).alias("source"),
        F.col(doc_id).alias("id"), word_count(F.col(text)).alias("size")))
    return in_line(whole, plan.join(shifts, "key")).select(
        "doc", "size", "source_size", "target", copies(F.col("shift")).alias("copies"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document as many times as it has copies, columns unchanged."""
    copies = mix(docs, **settings).filter("copies > 0")
    return copies.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
