"""Near-duplicate classes from bottom-k sketches of one hash function.

A document's set are its distinct word shingles, each a 64-bit hash. All sets are ordered
by one global order: frequency class first, then hash. A sketch is the lowest
``k = n - ceil(J n) + 1`` values of a set of n. Two sets with Jaccard of at least J share
``o = ceil(J/(1+J) (n1+n2))`` values, so they share one among the lowest ``n1 - o + 1`` of one
and ``n2 - o + 1`` of the other, both inside the sketches: inverted lists of sketch values lose
no link, whatever the order. The frequency class only keeps common lines out of the lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa.llm import words
from rasterqa.llm.common import saved
from rasterqa.operators.components import star_labels

#: Common shingles that are ordered last, at most this many (16 bytes each when broadcast).
#: Values beyond keep class 0; the order stays global, so no link is lost.
MAX_COMMON = 1_000_000
#: A shingle is a candidate for the common ones if one task meets it so often.
COMMON_IN_TASK = 4
#: Values a task gathers before it sums them.
GATHER = 2_000_000
#: Rows of ids that may be broadcast to pick the texts to verify; beyond it a shuffle join does it.
BROADCAST_IDS = 1_000_000

SET = "id long, k1 long, k2 long, n int, sketch binary"


def shingle_sets(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and sorted distinct shingles of each text; fewer words than ``size`` are one shingle."""
    for lo, hi in words.chunks(texts):
        h, _, _, counts = words.word_hashes(texts[lo:hi])
        grams = words.gram_hashes(h, size)
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
        start = ends - counts
        at = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(counts - size + 1, 0)) - np.maximum(counts - size + 1, 0), np.maximum(counts - size + 1, 0)) + start[doc]
        value = grams[at] if len(doc) else np.zeros(0, np.uint64)
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[first], doc[first]
        cut = np.searchsorted(doc, np.arange(len(counts) + 1))
        for i, n in enumerate(counts):
            if 0 < n < size:
                short = words.gram_hashes(h[start[i]:ends[i]], int(n)) ^ np.uint64(n)
                yield lo + i, words.mix(short)
            else:
                yield lo + i, value[cut[i]:cut[i + 1]]


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return words.texts(batch.column(1), lower=True)


def add_counts(sums: tuple[np.ndarray, np.ndarray], held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and counts of ``sums`` with the values of ``held``, which is emptied, added; values not yet
    in ``sums`` must occur ``least`` times. Sorts in place and holds one copy of the values and a few masks."""
    value, count = sums
    new = np.concatenate([np.zeros(0, np.uint64), *held])
    held.clear()
    new.sort()
    count = count + (np.searchsorted(new, value, "right") - np.searchsorted(new, value))
    often = new[:max(len(new) - least + 1, 0)] == new[least - 1:]
    often[1:] &= new[1:len(often)] != new[:max(len(often) - 1, 0)]
    first = np.flatnonzero(often)
    fresh = new[first]
    times = np.searchsorted(new, fresh, "right") - first
    place = np.searchsorted(value, fresh)
    if len(value):
        unseen = value[np.minimum(place, len(value) - 1)] != fresh
        fresh, times, place = fresh[unseen], times[unseen], place[unseen]
    return np.insert(value, place, fresh), np.insert(count, place, times)


def gather_common(size: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight, sums = [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in words.slices(batches):
            for _, s in shingle_sets(texts_of(batch), size):
                held.append(s)
                weight += len(s)
                if weight > GATHER:
                    sums, weight = add_counts(sums, held, 2), 0
        value, count = add_counts(sums, held, least)
        often = count >= least
        yield pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(count[often])], names=["value", "count"])
    return run


def sketch_sets(size: int, percent: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, level = common.value
        for batch in words.slices(batches):
            ids = batch.column(0).to_pylist()
            out = [[], [], [], [], []]
            for i, s in shingle_sets(texts_of(batch), size):
                n, sketch = len(s), s[:0]
                if n:
                    rank = np.zeros(n, np.uint8)
                    if len(value):
                        at = np.minimum(np.searchsorted(value, s), len(value) - 1)
                        rank = np.where(value[at] == s, level[at], 0).astype(np.uint8)
                    sketch = s[np.lexsort((s, rank))][:n + (-percent * n // 100) + 1]
                with np.errstate(over="ignore"):
                    keys = np.array([s.sum(dtype=np.uint64), words.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                for col, v in zip(out, (ids[i], int(keys[0]), int(keys[1]), n, sketch.tobytes())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["id", "k1", "k2", "n", "sketch"])
    return run


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = batch.column("sketch")
        k = np.array([len(b) // 8 for b in sketch.to_pylist()], np.int64)
        value = np.frombuffer(b"".join(sketch.to_pylist()), np.int64)
        pos = np.arange(len(value)) - np.repeat(np.cumsum(k) - k, k)
        yield pa.RecordBatch.from_arrays([
            pa.array(value), pa.array(np.repeat(np.array(batch.column("rep")), k)),
            pa.array(np.repeat(np.array(batch.column("n")), k)), pa.array(pos.astype(np.int32))], names=["v", "rep", "n", "pos"])


def overlap_bounds(percent: int):
    """Pairs whose sketches still allow the similarity: the union of the two sketches below the
    lower end shows every difference, and there may be only so many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = np.array(batch.column("n_a")), np.array(batch.column("n_b"))
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist())):
                a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                need = -(-percent * int(na[i] + nb[i]) // (100 + percent))
                keep.append(both >= min(len(a) - (na[i] - need), len(b) - (nb[i] - need)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])
    return run


def full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            ids, out = batch.column(0), [s.tobytes() for _, s in shingle_sets(texts_of(batch), size)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["id", "shingles"])
    return run


def confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])
    return run


def allowed(n1: str, p1: str, n2: str, p2: str, percent: int) -> Column:
    """Sizes fit and the shared value lies within both prefixes that must share one."""
    need = F.ceil(F.lit(percent) * (F.col(n1) + F.col(n2)) / F.lit(100 + percent))
    return ((F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent)
            & (F.col(p1) <= F.col(n1) - need) & (F.col(p2) <= F.col(n2) - need))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a > b`` whose full sets reach the similarity."""
    thin = reps.select("rep", "n", "sketch")
    left = thin.withColumnsRenamed({"rep": "a", "n": "n_a", "sketch": "s_a"})
    right = thin.withColumnsRenamed({"rep": "b", "n": "n_b", "sketch": "s_b"})
    likely = saved(pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(
        overlap_bounds(percent), "a long, b long"))
    needed = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    if likely.count() * 2 <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    sets = saved(docs.join(needed, "id", "left_semi").select("id", "text").mapInArrow(full_sets(size), "id long, shingles binary"))
    sets = sets.dropDuplicates(["id"])
    return saved(
        likely.join(sets.withColumnsRenamed({"id": "a", "shingles": "set_a"}), "a")
        .join(sets.withColumnsRenamed({"id": "b", "shingles": "set_b"}), "b")
        .mapInArrow(confirm(percent), "a long, b long"))


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: classes of documents linked by a Jaccard
    similarity of at least ``percent`` / 100 of their word shingles (A-Z lower-cased).

    Documents with equal sets are one class from the start, and only the class's smallest
    id goes on. First every sketch value's list is held against its smallest id;
    what that links is joined up, and then every pair of a list whose classes
    still differ is looked at. Pairs pass the bound of their two sketches and are confirmed
    on full sets, so a large group costs one pair a member, and no link between
    different classes is missed.

    Null or empty texts have an empty set and are linked with nothing; fewer words than ``size``
    are one shingle of their own kind; repeated rows of one id are one document and each get its result
    (ids are taken to name one text); a null id is its own document without links; an empty table gives
    no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    common = saved(
        docs.mapInArrow(gather_common(size, COMMON_IN_TASK), "value long, count long")
        .groupBy("value").agg(F.sum("count").alias("count")))
    top = common.orderBy(F.desc("count"), "value").limit(MAX_COMMON).toArrow()
    value = np.array(top.column("value"), np.int64).view(np.uint64)
    level = np.log2(np.maximum(np.array(top.column("count"), float), 1)).astype(np.uint8)
    order = np.argsort(value)
    sent = spark.sparkContext.broadcast((value[order], level[order]))

    sets = saved(docs.mapInArrow(sketch_sets(size, percent, sent), SET))
    classes = sets.filter("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(
        F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    reps = saved(classes)

    listed = reps.select("rep", "n", "sketch").mapInArrow(postings, "v long, rep long, n int, pos int")
    pivots = listed.groupBy("v").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n", "pos")).alias("p")).filter("members > 1")
    lists = saved(listed.join(pivots.select("v", "p"), "v"))
    flat = lists.select("v", "rep", "n", "pos", F.col("p.rep").alias("b"), F.col("p.n").alias("n_b"), F.col("p.pos").alias("p_b"))
    star = flat.filter(F.col("rep") > F.col("b")).filter(allowed("n", "pos", "n_b", "p_b", percent)).select(
        F.col("rep").alias("a"), "b").distinct()
    links = verified(star, reps, docs, size, percent)
    labels = _labels(links)

    member = lists.select("v", "rep", "n", "pos", F.col("p.rep").alias("pivot"))
    known = member.join(labels.withColumnsRenamed({"u": "rep", "v": "low"}), "rep", "left").withColumn("comp", F.coalesce("low", "rep"))
    known = known.join(labels.withColumnsRenamed({"u": "pivot", "v": "p_low"}), "pivot", "left").withColumn(
        "apart", F.col("comp") != F.coalesce("p_low", "pivot")).select("v", "rep", "n", "pos", "comp", "apart")
    known = saved(known)
    x = known.filter("apart").select("v", F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("pos").alias("p_x"), F.col("comp").alias("c_x"))
    y = known.select("v", F.col("rep").alias("y"), F.col("n").alias("n_y"), F.col("pos").alias("p_y"), F.col("comp").alias("c_y"))
    rest = x.join(y, (x.v == y.v) & (x.c_x != y.c_y) & allowed("n_x", "p_x", "n_y", "p_y", percent))
    rest = rest.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    labels = _labels(links.union(verified(rest, reps, docs, size, percent)))

    class_of = reps.select("k1", "k2", F.col("n").alias("n_shingles"), "rep").join(
        labels.withColumnsRenamed({"u": "rep", "v": "low"}), "rep", "left").withColumn("component_id", F.coalesce("low", "rep"))
    full = sets.filter("n > 0 and id is not null").select("id", "k1", "k2", F.col("n").alias("n_shingles")).join(
        class_of, ["k1", "k2", "n_shingles"]).select("id", "n_shingles", "component_id")
    empty = sets.filter("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.union(empty).select(
        F.col("id").alias(doc_id), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _labels(links: DataFrame) -> DataFrame:
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    return edges if edges.isEmpty() else star_labels(edges, ())


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of documents that stay: the smallest id of each class, columns unchanged.

    Rows that repeat an id stay or go together.
    """
    gone = near_duplicates(docs, doc_id=doc_id, **settings).filter(~F.col("kept")).select(F.col(doc_id).alias("gone_id")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone.gone_id, "left_anti")
