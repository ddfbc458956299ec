"""Packing documents into fixed windows: bounded-space online best fit."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterqa.llm import words
from rasterqa.llm.common import saved

WINDOW = 4096
OPEN_WINDOWS = 16
#: Partitions whose leftover windows are merged by one task.
FAN_IN = 8
END_ID = 2
#: Words kept with their ids by one task; the store is emptied beyond that.
WORD_STORE = 500_000
LETTERS = re.compile(rb"([a-z\xc3-\xc9\x80-\xbf]+)([!-&(-/:-@[-`{-~]*)", re.DOTALL)
#: How byte-level vocabularies spell bytes: printable ones as themselves, the others, in
#: order, from U+0100 on.
BYTE_LETTERS = dict(zip(
    [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)], range(256, 512)))

PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("part", pa.int64()), ("window", pa.int64()), ("ids", pa.binary()),
])
PIECE_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
             "part long, window long, ids binary")


class WordIds:
    """Token ids of texts, looked up word by word.

    The vocabulary's pre-tokeniser never joins text across white space and its normaliser
    works on one character and its combining marks, so a text's ids are those of its
    words in a row. Each distinct word is encoded once; the normaliser lower-cases, so
    words that differ in A-Z share their ids (texts that may hold special tokens keep their case).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted word hashes, and their slots
        self.start, self.length, self.ids = array("q", [0]), array("q", [1]), array("I", [END_ID])

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word. Latin letters that signs may follow go straight to the merges: the
        normaliser and the pre-tokeniser only fold the case and cut before the signs there."""
        m = LETTERS.fullmatch(word)
        if m is not None:
            text, tail = m[1].decode(), m[2]
            plain = text.isascii()
            if not plain:
                text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
                plain = text.isalpha() and max(text) <= "\u024f"
                text = text.encode().decode("latin-1").translate(BYTE_LETTERS)
            if plain:
                merge = self.tokenizer.model.tokenize
                return [t.id for t in merge(text)] + ([t.id for t in merge(tail.decode())] if tail else [])
        return self.tokenizer.encode(word.decode(), add_special_tokens=False).ids

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row, each text closed by the end id, and where each ends."""
        texts = [t if b"<|" in t else t.lower() for t in texts]
        h, first, end, counts = words.word_hashes(texts)
        found, where, at = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(found) > WORD_STORE:
            self.clear()
        place = np.searchsorted(self.known, found)
        new = np.ones(len(found), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != found
        raw, added = b"\n".join(texts), np.flatnonzero(new)
        fresh = np.arange(len(self.start), len(self.start) + len(added), dtype=np.int32)
        for i in where[added].tolist():
            ids = self.encode(raw[first[i]:end[i]])
            self.start.append(len(self.ids))
            self.length.append(len(ids))
            self.ids.extend(ids)
        self.known, self.slot = np.insert(self.known, place[added], found[added]), np.insert(self.slot, place[added], fresh)
        slots = self.slot[np.searchsorted(self.known, found)]
        row = np.insert(slots[at], np.cumsum(counts), 0)  # slot 0: the end id
        length = np.frombuffer(self.length, np.int64)[row]
        upto = np.cumsum(length)
        out = np.frombuffer(self.ids, np.uint32)[np.repeat(np.frombuffer(self.start, np.int64)[row] - upto + length, length) + np.arange(upto[-1] if len(upto) else 0)]
        return out.astype("<u4"), upto[np.cumsum(counts + 1) - 1]


@cache
def word_ids(path: str) -> WordIds:
    """One store per Python worker, which lives through many tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path)


class OpenWindows:
    """A fixed number of windows being filled; ``put`` places a piece best-fit."""

    def __init__(self, count: int, size: int):
        self.count, self.size = count, size
        self.open: list[tuple[int, list]] = []

    def put(self, piece: tuple, length: int) -> list | None:
        """Returns the fullest window when it had to make room, else None."""
        best = -1
        for i, (used, _) in enumerate(self.open):
            if used + length <= self.size and (best < 0 or used > self.open[best][0]):
                best = i
        out = None
        if best < 0:
            if len(self.open) >= self.count:
                best = max(range(len(self.open)), key=lambda i: self.open[i][0])
                out = self.open.pop(best)[1]
            self.open.append((length, [piece]))
            best = len(self.open) - 1
        else:
            used, held = self.open[best]
            held.append(piece)
            self.open[best] = (used + length, held)
        if self.open[best][0] == self.size:
            full = self.open.pop(best)[1]
            return full if out is None else out + [None] + full
        return out


class Rows:
    """Gathers output rows and hands them out as Arrow batches of bounded size."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.weight = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.weight += 100 + len(row[-1] or b"")

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*self.rows), PIECE)] if self.rows
            else [pa.array([], f.type) for f in PIECE], schema=PIECE)
        self.rows, self.weight = [], 0
        return out


def pack_partition(path: str, size: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids_of, windows, out, made = word_ids(path), OpenWindows(open_windows, size), Rows(), 0

        def close(pieces):
            nonlocal made
            at = 0
            for p in pieces:
                if p is None:
                    made, at = made + 1, 0
                    continue
                doc, start, ids, tokens = p
                n = len(ids) // 4
                out.add((doc, start, n, zlib.crc32(ids), tokens, (part << 32) + made, at, part, made, None))
                at += n
            made += 1

        for batch in words.slices(batches):
            docs = batch.column(0).to_pylist()
            texts = words.texts(batch.column(1))
            for lo, hi in words.chunks(texts):
                ids, ends = ids_of(texts[lo:hi])
                at = 0
                for doc, end in zip(docs[lo:hi], ends.tolist()):
                    for start in range(at, end, size):
                        piece = ids[start:min(start + size, end)].tobytes()
                        done = windows.put((doc, start - at, piece, end - at), len(piece) // 4)
                        if done:
                            close(done)
                    at = end
                if out.weight > 4 << 20:
                    yield out.batch()
        for w, (_, pieces) in enumerate(windows.open):  # left over: their ids travel on
            for doc, start, ids, tokens in pieces:
                out.add((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, None, None, part, made + w, ids))
        yield out.batch()

    return run


def merge_leftovers(size: int, parts_bits: int = 62):
    """Leftover pieces in a row, cut at window ends: one open end per group of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, at, made = Rows(), None, 0, 0
        for batch in batches:
            for doc, start, tokens, part, ids in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "part", "ids"))):
                if part // FAN_IN != group:
                    group, at, made = part // FAN_IN, 0, 0
                while ids:
                    piece, ids = ids[:4 * (size - at)], ids[4 * (size - at):]
                    n = len(piece) // 4
                    out.add((doc, start, n, zlib.crc32(piece), tokens, (1 << parts_bits) + (group << 32) + made, at, part, made, None))
                    start, at = start + n, at + n
                    if at == size:
                        at, made = 0, made + 1
            if out.weight > 4 << 20:
                yield out.batch()
        yield out.batch()

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids and an end id. It is cut every ``size`` ids; each piece
    goes best-fit into one of ``open_windows`` windows of its partition, and the fullest
    is emitted when none fits. What is open at the end of a partition goes, with its ids, to
    a merge of ``FAN_IN`` partitions each, which fills windows to the brim and leaves one
    short window. Sequences are gapless from offset 0; only their ends are padding.

    Null and empty texts are a lone end id; long texts fill windows of their own; repeated rows
    are documents of their own; an empty table gives no rows; other columns are ignored.
    The first pass is written once, so both readers see the same windows. A task
    holds its open windows, a few megabytes of text and a bounded store of words.
    """
    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = saved(thin.mapInArrow(pack_partition(tokenizer, size, open_windows), PIECE_DDL))
    group = F.floor(F.col("part") / FAN_IN)
    left = first.filter("ids is not null").repartition(group).sortWithinPartitions(group, "part", "window", "doc_id", "start")
    merged = left.mapInArrow(merge_leftovers(size), PIECE_DDL)
    return first.filter("ids is null").unionByName(merged).drop("part", "window", "ids")
