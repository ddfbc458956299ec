"""Near hashes against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from rasterqa.operators import hashjoin

SCHEMA = "image_id long, hash long"


def signed(w):
    return w - (1 << 64) if w >> 63 else w


def plain(rows, bits):
    rep, members = {}, {}
    for i, w in sorted({r for r in rows if r[1] is not None}):
        rep.setdefault(w, i)
        members[w] = members.get(w, 0) + 1
    words, out = sorted(rep), []
    for n, a in enumerate(words):
        for b in words[n + 1:]:
            d = bin((a ^ b) & ((1 << 64) - 1)).count("1")
            if d <= bits:
                x, y = sorted((a, b), key=rep.get)
                out.append((rep[x], rep[y], d, members[x], members[y]))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(1), []
    base = [rnd.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    for i in range(1500):
        w = rnd.choice(base)
        for _ in range(rnd.randint(0, 5)):
            w ^= 1 << rnd.randint(0, 63)
        out.append((i, signed(w)))
    return out + [(9000, None), (9001, None), out[0]] + [(10_000 + i, out[5][1]) for i in range(400)]


@pytest.mark.parametrize("bits, bucket", [(3, 256), (3, 4), (0, 256), (6, 30)])
def test_near_pairs(spark, rows, bits, bucket):
    got = hashjoin.near_pairs(spark.createDataFrame(rows, SCHEMA), bits, bucket=bucket)
    assert sorted(map(tuple, got.collect())) == plain(rows, bits)


def test_a_common_hash_is_one_representative(spark, rows):
    classes = {r.image_id: r.rep_id for r in hashjoin.hash_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    first = {}
    for i, w in sorted({r for r in rows if r[1] is not None}):
        first.setdefault(w, i)
    assert classes == {i: i if w is None else first[w] for i, w in rows}
    many = spark.range(20_000).select(F.col("id").alias("image_id"), F.lit(7).cast("long").alias("hash"))
    assert hashjoin.near_pairs(many).count() == 0 and hashjoin.hash_classes(many).select("rep_id").distinct().count() == 1


def test_hashes_that_share_most_bits_are_split(spark):
    close = [(i, i) for i in range(4096)]  # 52 equal bits: all of them meet in every band but the last
    got = hashjoin.near_pairs(spark.createDataFrame(close, SCHEMA), 1, bucket=16)
    assert got.count() == 4096 * 12 // 2


def test_empty_and_wrong(spark):
    assert hashjoin.near_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        hashjoin.near_pairs(spark.createDataFrame([], SCHEMA), 64)
