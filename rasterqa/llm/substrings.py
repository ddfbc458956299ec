"""Repeated long word sequences across documents, by prefix groups of suffixes.

A suffix is a document's word sequence from one place on, followed to ``depth`` words. In
the suffix tree of all documents, an internal node of that depth with two leaves or more is a
repeat; its leaves are the places to mark. The tree is built in parts whose prefixes have
variable length, as many words as it takes to make a part fit a task:

* none of the suffixes whose prefix group is sure to have one leaf are kept: the least hash
  of ``GRAM`` words inside a window is the same wherever the window stands, so a window
  is dropped if that anchor occurs once in all documents;
* suffixes with a rarer anchor go to the subtree of that anchor, a few dozen words in common;
* suffixes with an anchor of more than ``PART_ROWS`` places go by all of their ``depth`` words,
  and equal ones are counted before they are sent.

Edges are compared by 64-bit hashes of words and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterqa.llm import words
from rasterqa.llm.common import saved

DEPTH = 35
GRAM = 8
PART_ROWS = 50_000
#: Each bitmap of anchors has so many bits, whatever the input: what is broadcast is 16 MB. A
#: fuller map lets more suffixes through and changes no result.
MAP_BITS = 1 << 26
BLOCK_BITS = 1 << 16
#: Windows in a row with one anchor, at most, in a row of the table.
RUN = 32


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each ``width`` neighbours."""
    out, w = a, 1
    while 2 * w <= width:
        out = pick(out[:-w], out[w:])
        w *= 2
    return out if w == width else pick(out[:len(a) - width + 1], out[width - w:])


def windows_of(h: np.ndarray, counts: np.ndarray, depth: int):
    """Anchor value of the window at each place (0: no whole window of one document there)
    and the hash of ``GRAM`` words at each place."""
    n = len(h)
    if n < depth:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = min(GRAM, depth)
    g = words.gram_hashes(h, gram)
    v = sliding(g, depth - gram + 1, np.minimum)
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.where(doc[:len(v)] == doc[depth - 1:], v, 0), g, doc


def count_anchors(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.texts(batch.column(0))
            found = []
            for lo, hi in words.chunks(texts):
                h, _, _, counts = words.word_hashes(texts[lo:hi])
                v, g, _ = windows_of(h, counts, depth)
                if not len(v):
                    continue
                w = len(g) - len(v) + 1
                edge = np.zeros(w - 1, np.uint64)
                reach = sliding(np.concatenate([edge, v, edge]), w, np.maximum)
                found.append(g[(reach == g) & (reach > 0)])
            value, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))], names=["anchor", "n"])
    return run


def bit_of(value: np.ndarray) -> np.ndarray:
    return value.view(np.uint64) >> np.uint64(64 - (MAP_BITS - 1).bit_length())


def bitmap_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the anchors of a task, as blocks of ``BLOCK_BITS``."""
    bits = [np.zeros(0, np.uint64)]
    for batch in batches:
        bits.append(np.unique(bit_of(np.array(batch.column(0)))))
    at = np.unique(np.concatenate(bits)).astype(np.int64)
    block = at // BLOCK_BITS
    for b in np.unique(block):
        one = np.zeros(BLOCK_BITS, bool)
        one[at[block == b] % BLOCK_BITS] = True
        yield pa.RecordBatch.from_arrays([pa.array([int(b)]), pa.array([np.packbits(one).tobytes()])], names=["block", "bits"])


def bitmap(anchors: DataFrame):
    """A broadcast bitmap of the anchors, of fixed size. Tasks hold ranges of bits."""
    top = F.shiftrightunsigned("anchor", 64 - (MAP_BITS // BLOCK_BITS - 1).bit_length()).cast("int")
    blocks = anchors.select("anchor").repartition(top).mapInArrow(bitmap_blocks, "block long, bits binary")
    whole = np.zeros(MAP_BITS // 8, np.uint8)
    for r in blocks.toLocalIterator():
        whole[r.block * BLOCK_BITS // 8:(r.block + 1) * BLOCK_BITS // 8] |= np.frombuffer(r.bits, np.uint8)
    return anchors.sparkSession.sparkContext.broadcast(whole)


def marked(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = bit_of(value)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def suffix_runs(depth: int, repeated, frequent):
    """Windows that may repeat, as runs with one anchor: their hashes in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, hot = repeated.value, frequent.value
        for batch in batches:
            ids, keys = np.array(batch.column(1)), np.array(batch.column(2))
            texts = words.texts(batch.column(0))
            for lo, hi in words.chunks(texts):
                h, _, _, counts = words.word_hashes(texts[lo:hi])
                v, _, doc = windows_of(h, counts, depth)
                on = np.flatnonzero((v > 0) & marked(keep, v)) if len(v) else np.zeros(0, np.int64)
                if not len(on):
                    continue
                whole = words.roll_hashes(h, depth)[on]
                new = np.ones(len(on), bool)
                new[1:] = (np.diff(on) != 1) | (v[on[1:]] != v[on[:-1]]) | (doc[on[1:]] != doc[on[:-1]])
                start = np.flatnonzero(new)
                length = np.diff(np.append(start, len(on)))
                extra = (length - 1) // RUN
                first = np.repeat(start, extra + 1)
                first = first + RUN * (np.arange(len(first)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1))
                length = np.diff(np.append(first, len(on)))
                place = on[first]
                d = doc[place]
                base = np.cumsum(counts) - counts
                offsets = np.append(first, len(on)).astype(np.int32) * 8
                hashes = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(whole))])
                yield pa.RecordBatch.from_arrays([
                    pa.array(v[place].view(np.int64)), pa.array(ids[lo + d]), pa.array(keys[lo + d]),
                    pa.array((place - base[d]).astype(np.int32)), pa.array(marked(hot, v[place])), hashes,
                ], names=["anchor", "id", "key", "place", "hot", "hashes"])
    return run


def deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the windows that have an equal one in their subtree. Rows come sorted by
    anchor; the last anchor of a batch waits for the next."""
    names = ["anchor", "id", "key", "place", "hashes"]

    def nodes(t: pa.Table) -> pa.RecordBatch:
        raw = [b or b"" for b in t.column("hashes").to_pylist()]
        size = np.array([len(b) // 8 for b in raw], np.int64)
        h = np.frombuffer(b"".join(raw), np.uint64)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        start = np.cumsum(size) - size
        bit = twice.astype(np.int64) << (np.arange(len(h)) - np.repeat(start, size))
        mask = np.add.reduceat(bit, start) if len(start) else np.zeros(0, np.int64)
        on = pa.array(mask > 0)
        cols = [t.column(c).combine_chunks().filter(on) for c in ("id", "key", "place")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(mask[mask > 0])], names=["id", "key", "place", "mask"])

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch]).select(names)
        t = t if held is None else pa.concat_tables([held, t])
        a = np.array(t.column("anchor"))
        cut = int(np.flatnonzero(a != a[-1])[-1]) + 1 if len(a) and (a != a[-1]).any() else 0
        if cut:
            yield nodes(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield nodes(held)


def cover(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for doc, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                w = words.encode(text).split()
                n, gone = len(w), 0
                if marks:
                    edge = np.zeros(n + 1, np.int64)
                    for m in marks:
                        bits = np.flatnonzero((m["mask"] >> np.arange(RUN)) & 1) + m["place"]
                        np.add.at(edge, bits, 1)
                        np.add.at(edge, bits + depth, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = n - int(stay.sum())
                    w = [w[i] for i in np.flatnonzero(stay)]
                kept = b" ".join(w)
                for col, v in zip(out, (doc, n, gone, kept)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])
    return run


def remove_repeats(documents: DataFrame, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: documents without the words that lie in a window
    of ``depth`` words which also starts elsewhere, the same document included. ``kept`` are the
    remaining words joined by spaces, as UTF-8 bytes.

    Windows are judged on the input. Null and empty texts have no words; texts shorter than
    ``depth`` words keep all; repeated rows are documents of their own and so repeat each other;
    an empty table gives no rows; other columns are ignored.
    """
    docs = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).cast("long").alias("id"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    anchors = saved(docs.select("text").mapInArrow(count_anchors(depth), "anchor long, n long").groupBy("anchor").agg(
        F.sum("n").alias("n")).filter("n > 1"))
    repeated = bitmap(anchors)
    frequent = bitmap(anchors.filter(F.col("n") > PART_ROWS))
    runs = saved(docs.select("text", F.coalesce("id", F.lit(0)).alias("id"), "key").mapInArrow(
        suffix_runs(depth, repeated, frequent), "anchor long, id long, key long, place int, hot boolean, hashes binary"))
    parts = runs.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    marks = parts.mapInArrow(deep_nodes, "id long, key long, place int, mask long")
    longer = runs.filter("hot").select("id", "key", "place", F.posexplode(F.transform(
        F.sequence(F.lit(0), (F.length("hashes") / 8).cast("int") - 1), lambda i: F.substring("hashes", i * 8 + 1, F.lit(8))))).select(
        "id", "key", (F.col("place") + F.col("pos")).alias("place"), F.col("col").alias("window"))
    twice = longer.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    marks = marks.union(longer.join(twice, "window").select("id", "key", "place", F.lit(1).cast("long")))
    by_doc = marks.groupBy("id", "key").agg(F.collect_set(F.struct("place", "mask")).alias("marks")).withColumnsRenamed(
        {"id": "m_id", "key": "m_key"})
    on = (F.coalesce(docs["id"], F.lit(0)) == by_doc.m_id) & (docs["key"] == by_doc.m_key)
    out = docs.join(by_doc, on, "left").select("id", "text", "marks").mapInArrow(
        cover(depth), "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumnRenamed("doc_id", doc_id)
