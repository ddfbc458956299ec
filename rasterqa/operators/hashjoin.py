"""Near-duplicate search over 64-bit hashes: exact Hamming join by repeated pigeonhole.

Two hashes at most ``max_bits`` apart agree in one of ``max_bits + 1`` bands, so a hash is sent to a
bucket for each of its bands. A bucket with many different hashes is not paired off: the same
argument holds for the bits it has not used yet, so its hashes go to the bands of those, level by
level, until buckets are small or the bits are used up. Every near pair meets in some bucket at each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa.session import cut_lineage

BITS = 64
#: Different hashes that one bucket pairs off; fuller buckets are split.
BUCKET = 256


def distance(a: str, b: str) -> Column:
    """Differing bits of two words."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def hash_classes(hashes: DataFrame, image: str = "image_id", word: str = "hash") -> DataFrame:
    """``image_id, rep_id``: images with equal hashes under the smallest id among them.

    Images without a hash are alone. An id may repeat; it counts once.
    """
    rows = hashes.select(F.col(image).alias("image_id"), F.col(word).cast("bigint").alias("hash")).distinct()
    reps = rows.filter("hash is not null").groupBy("hash").agg(F.min("image_id").alias("rep_id"))
    return rows.join(reps, "hash", "left").select("image_id", F.coalesce("rep_id", "image_id").alias("rep_id")).distinct()


def distinct_hashes(hashes: DataFrame, image: str = "image_id", word: str = "hash") -> DataFrame:
    """``rep_id, members, hash``: one row for each hash. Sums combine before the shuffle, so a hash
    that a third of the images share is no hot key."""
    rows = hashes.select(F.col(image).alias("image_id"), F.col(word).cast("bigint").alias("hash")).filter("hash is not null")
    return rows.distinct().groupBy("hash").agg(F.min("image_id").alias("rep_id"), F.count("*").alias("members"))


def banded(rows: DataFrame, bands: int) -> DataFrame:
    """Each row once for each band of its remaining bits, under the bucket of the band's value.

    ``rest`` holds the ``bits`` bits not used so far, closed up; the bucket names chain by hash,
    where a collision only adds pairs that are looked at.
    """
    i = F.col("band")
    low = F.expr("cast(band * bits div {0} as int)".format(bands))
    high = F.expr("cast((band + 1) * bits div {0} as int)".format(bands))
    wide = rows.withColumn("band", F.explode(F.array(*[F.lit(b) for b in range(bands)])))
    cut = wide.select("*", low.alias("low"), (high - low).alias("width"))
    ones = lambda n: F.expr(f"shiftleft(1L, {n}) - 1")
    value = F.expr("shiftrightunsigned(rest, low)").bitwiseAND(ones("width"))
    left = F.when(F.col("low") + F.col("width") >= BITS, F.lit(0).cast("bigint")).otherwise(
        F.expr("shiftleft(shiftrightunsigned(rest, low + width), low)"))
    return cut.select(
        "hash", F.xxhash64("bucket", i, value).alias("bucket"),
        F.col("rest").bitwiseAND(ones("low")).bitwiseOR(left).alias("rest"), (F.col("bits") - F.col("width")).alias("bits"))


def paired(rows: DataFrame, max_bits: int) -> DataFrame:
    """Near pairs inside the buckets, smaller word first."""
    a = rows.select("bucket", F.col("hash").alias("hash_a"))
    b = rows.select("bucket", F.col("hash").alias("hash_b"))
    return a.join(b, "bucket").filter((F.col("hash_a") < F.col("hash_b")) & (distance("hash_a", "hash_b") <= max_bits)).select("hash_a", "hash_b")


def near_pairs(hashes: DataFrame, max_bits: int = 3, image: str = "image_id", word: str = "hash", bucket: int = BUCKET) -> DataFrame:
    """``rep_a, rep_b, distance, members_a, members_b``: pairs of different hashes at most
    ``max_bits`` bits apart, by the smallest image of each hash and the number of images that share it.

    With ``hash_classes`` this is the whole relation: copies are near each other at distance 0
    and near whatever their representative is near, and are not paired off one by one. Images
    without a hash have no pairs. The buckets of a level are counted before they are joined; a
    bucket of more than ``bucket`` hashes goes on to the next level and no pair is lost.
    """
    if not 0 <= max_bits < BITS:
        raise ValueError("max_bits lies between 0 and 63")
    bands = max_bits + 1
    words = cut_lineage(distinct_hashes(hashes, image, word))
    rows = words.select("hash", F.lit(0).cast("bigint").alias("bucket"), F.col("hash").alias("rest"), F.lit(BITS).alias("bits"))
    found = None
    while True:
        rows = cut_lineage(banded(rows, bands))
        full = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("bits").alias("left")).filter(
            (F.col("n") > bucket) & (F.col("left") >= bands)).select("bucket")
        full = cut_lineage(full)
        pairs = paired(rows.join(full, "bucket", "left_anti"), max_bits)
        found = pairs if found is None else found.union(pairs)
        if full.isEmpty():
            break
        rows = rows.join(full, "bucket", "left_semi")
    side = lambda c: words.select(F.col("hash").alias(f"hash_{c}"), F.col("rep_id").alias(f"rep_{c}"), F.col("members").alias(f"members_{c}"))
    both = found.distinct().join(side("a"), "hash_a").join(side("b"), "hash_b")
    swap = F.col("rep_a") > F.col("rep_b")
    pick = lambda c, a, b: F.when(swap, F.col(f"{c}_{b}")).otherwise(F.col(f"{c}_{a}")).alias(f"{c}_{a}")
    return both.select(pick("rep", "a", "b"), pick("rep", "b", "a"), distance("hash_a", "hash_b").alias("distance"),
                       pick("members", "a", "b"), pick("members", "b", "a"))
