"""n-gram language model in a log-frequency Bloom filter.

Counts are quantised to levels of a logarithmic scale, and an n-gram of level q is put into the filter
q times, once for each level up to its own. To read a count, the levels are probed in turn until
one is missing; a false positive is as likely to add a level as the filter's error rate, and to add two only
as its square. No n-gram is more frequent than its suffix or its context one word shorter, so a level
counts only up to theirs; single words are counted exactly and stay out of the filter. Probabilities interpolate the orders by Dirichlet smoothing:
``p(w | h) = (c(hw) + s p(w | h')) / (c(h) + s)``, down to additive smoothing of single words.

The filter is cut into parts by n-gram hash, and texts are dealt into chunks. A chunk sends its distinct
n-grams to their parts; each part is filled where the counts of its n-grams meet, reads the levels of what was asked
from its bits, and sends them back, a byte for each n-gram. The chunk's texts are scored with these. So the work is two
shuffles of the texts and one of the n-grams whatever the size of the filter, and no task holds more of it than a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa.llm import words
from rasterqa.llm.common import partitions, saved

ORDER = 3
#: N-grams of two words or more are kept from this count on: all of them.
LEAST_COUNT = 1
#: Bases of the levels of single words and of longer n-grams: counts of one level lie within
#: this factor. The first level starts at the least count that is kept.
BASES = (1.25, 1.5)
BITS_PER_ITEM = 10
PROBES = 5
MAX_LEVEL = 200
#: Pseudo-count of the lower order in each mixture, and of every word.
STRENGTH = 4.0
ADD = 0.1
#: Parts that are gathered to read counts on the driver, at most.
SEND_MB = 96
#: Tokens of a chunk of texts, about, and the least on which one more task is worth its while.
CHUNK_TOKENS, TASK_TOKENS = 3_000_000, 500_000
#: How the levels that go back to the chunks are packed on disk.
STATE_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
#: N-grams that one part of the filter holds, about.
PART_ITEMS = 1_600_000

END = np.uint64(0x2545F4914F6CDD1D)
BREAK = np.uint64(0x9E6C63D0876A9A47)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and, after each text, of its end; tokens of each text."""
    h, _, _, counts = words.word_hashes(texts)
    return np.insert(h, np.cumsum(counts), END), counts + 1


def ngrams(tokens: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` tokens that end at each place. Places before a text's first
    word hold a mark of the break, so contexts don't cross texts."""
    start = np.repeat(np.cumsum(counts) - counts, counts)
    at = np.arange(len(tokens)) - start
    out = words.mix(np.full(len(tokens), n, np.uint64))
    for back in range(n - 1, -1, -1):
        shifted = np.concatenate([np.zeros(back, np.uint64), tokens[:len(tokens) - back]]) if back else tokens
        out = words.mix(out ^ np.where(at >= back, shifted, BREAK))
    return out


def grams(tokens: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    return tokens if n == 1 else ngrams(tokens, counts, n)


def level_of(count: np.ndarray, n: int, least: int = LEAST_COUNT) -> np.ndarray:
    """Level of a count of an n-gram of ``n`` words that is kept."""
    base, start = BASES[n > 1], 1 if n == 1 else least
    return np.minimum(1 + np.floor(np.log(np.maximum(count, start) / start) / math.log(base) + 1e-9), MAX_LEVEL).astype(np.int64)


def value_of(n: int, least: int = LEAST_COUNT) -> np.ndarray:
    """The count that each level stands for; counts thin out towards the upper end of a level's
    range, so it is a third of the way on the scale. Level 0 is 0."""
    base, start = BASES[n > 1], 1 if n == 1 else least
    low = start * base ** np.arange(MAX_LEVEL)
    return np.concatenate([[0.0], np.where(np.ceil(low) + 1 > low * base, np.ceil(low), low * base ** (1 / 3))])


def highest(n: int, least: int = LEAST_COUNT) -> np.ndarray:
    """For each level of an (n - 1)-gram the level that an n-gram which holds it can have at most."""
    q = np.arange(MAX_LEVEL + 1)
    if n > 2:
        return q
    top = np.floor(BASES[0] ** q.astype(float))  # the largest count of each level of single words
    return np.where(q == 0, 0, np.where(q == MAX_LEVEL, MAX_LEVEL, level_of(top, n, least)))


def bounds(below: np.ndarray, first: np.ndarray, n: int, least: int, texts: int) -> np.ndarray:
    """Level that the n-gram at each place can have at most, by the levels ``below`` of the (n - 1)-grams
    at its own place (suffix) and the one before (context). A first word has the break as context."""
    top = highest(n, least)[below]
    context = np.concatenate([top[:1], top[:-1]])
    return np.minimum(top, np.where(first, level_of(np.int64([texts]), n, least), context))


def first_words(counts: np.ndarray) -> np.ndarray:
    first = np.zeros(int(counts.sum()), bool)
    first[np.cumsum(counts) - counts] = True
    return first


def probe_bits(key: np.ndarray, level: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit numbers of a (key, level) item in a part of ``bits`` bits: one row per probe."""
    a = words.mix(key ^ words.mix(level.astype(np.uint64)))
    b = words.mix(a) | np.uint64(1)
    return np.stack([bit_number(a + np.uint64(k) * b, bits) for k in range(PROBES)])


def bit_number(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The upper half of a hash, scaled to a number below ``bits`` (which is below 2**32)."""
    return ((x >> np.uint64(32)) * bits) >> np.uint64(32)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes: sorted ones are read part by part, and agree in their first bits within one."""
    return bit_number(key, np.uint64(parts)).astype(np.int64)


def by_byte(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then all second ones, and so on: the equal ones compress."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_bytes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: Bytes of the difference of two neighbours among a chunk's sorted hashes that are even noise.
NOISE = 5


def squeezed(key: np.ndarray) -> bytes:
    """Sorted hashes as differences, of which only the upper bytes can be packed."""
    raw, noise = by_byte(np.diff(key, prepend=np.uint64(0))), NOISE * len(key)
    return raw[:noise] + pa.compress(raw[noise:], codec="zstd", asbytes=True)


def hashes_from(raw: bytes, size: int) -> np.ndarray:
    upper = pa.decompress(raw[NOISE * size:], (8 - NOISE) * size, codec="zstd", asbytes=True)
    return np.cumsum(from_bytes(raw[:NOISE * size] + upper, "<u8"), dtype=np.uint64)


def packed_numbers(x: np.ndarray) -> bytes:
    return pa.compress(by_byte(x), codec="zstd", asbytes=True)


def numbers_from(raw: bytes, size: int, kind: str) -> np.ndarray:
    return from_bytes(pa.decompress(raw, np.dtype(kind).itemsize * size, codec="zstd", asbytes=True), kind)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and how often each occurs."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return key[first], np.diff(first, append=len(key))


PACKED = "part long, chunk long, n int, size long, keys binary, counts binary, bits binary"


def packed(chunk: int, n: int, key: np.ndarray, count: np.ndarray, parts: int) -> pa.RecordBatch:
    """Sorted distinct n-grams and their counts, a row for each part that they fall into."""
    part = part_of(key, parts)
    cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    names, count = part[cut[:-1]], np.minimum(count, 2**32 - 1).astype("<u4")
    ranges = list(zip(cut[:-1], cut[1:]))
    return pa.RecordBatch.from_arrays([
        pa.array(names), pa.array(np.full(len(names), chunk, np.int64)), pa.array(np.full(len(names), n, np.int32)),
        pa.array(np.diff(cut)), pa.array([squeezed(key[a:b]) for a, b in ranges], pa.binary()),
        pa.array([packed_numbers(count[a:b]) for a, b in ranges], pa.binary()),
        pa.nulls(len(names), pa.binary())], names=[c.split()[0] for c in PACKED.split(", ")])


def count_grams(order: int, parts: int):
    """Counts of a task's n-grams, packed by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = 0

        def flush():
            nonlocal size
            for n in range(order):
                yield packed(-1, n + 1, *distinct(np.concatenate(held[n])), parts)
                held[n].clear()
            size = 0

        for batch in words.slices(batches):
            texts = words.texts(batch.column(0), lower=True)
            for lo, hi in words.chunks(texts):
                tokens, counts = token_hashes(texts[lo:hi])
                for n in range(order):
                    held[n].append(grams(tokens, counts, n + 1))
                size += len(tokens)
                if size > 4_000_000:
                    yield from flush()
        if size:
            yield from flush()
    return run


def ask(order: int, parts: int):
    """A chunk's distinct n-grams, packed by part, with their counts in the texts to learn from."""
    def run(chunk: pa.Table) -> pa.Table:
        words.give_back()
        tokens, counts = chunk_tokens(chunk)
        held = np.repeat(~np.array(chunk.column("learn"), bool), counts)
        rows = []
        for n in range(1, order + 1):
            gram = grams(tokens, counts, n)
            key, count = distinct(gram)
            out, less = distinct(gram[held])
            count[np.searchsorted(key, out)] -= less
            rows.append(packed(chunk.column("chunk")[0].as_py(), n, key, count, parts))
        return pa.Table.from_batches(rows)
    return run


def chunk_tokens(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    texts = words.texts(chunk.column("text"), lower=True)
    got = [token_hashes(texts[lo:hi]) for lo, hi in words.chunks(texts)]
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def each_part(finish):
    """``finish(part, rows)`` for the rows of every part, which come together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.give_back()
        waiting: tuple[int, list] | None = None
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting is not None and waiting[0] != part:
                    yield finish(*waiting)
                    waiting = None
                if waiting is None:
                    waiting = (part, [])
                waiting[1].append(row)
        if waiting is not None:
            yield finish(*waiting)
    return run


def met(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Of the rows of one part, by order: distinct n-grams, their counts in all, the place of
    every n-gram of the rows among them, and each row's chunk and number of n-grams."""
    out = {}
    for n in sorted({r[1] for r in rows if r[5] is None}):
        mine = [r for r in rows if r[1] == n and r[5] is None]
        key = np.concatenate([hashes_from(r[3], r[2]) for r in mine])
        count = np.concatenate([numbers_from(r[4], r[2], "<u4") for r in mine]).astype(np.int64)
        order = np.argsort(key)
        key, count = key[order], count[order]
        new = np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1]))
        first, back = np.flatnonzero(new), np.empty(len(key), np.int64)
        back[order] = np.cumsum(new) - 1
        out[n] = key[first], np.add.reduceat(count, first), back, [(r[0], r[2]) for r in mine]
    return out


def filled(part: int, found: dict, least: int) -> pa.RecordBatch:
    """Exact counts of the part's single words, and its bits for every longer n-gram that is kept."""
    words_key, words_count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    items_key, items_level = [], []
    for n, (key, count, _, _) in found.items():
        keep = count >= (1 if n == 1 else least)
        if n == 1:
            words_key, words_count = key[keep], count[keep]
            continue
        items_key.append(key[keep] ^ words.mix(np.uint64([n])))
        items_level.append(level_of(count[keep], n, least))
    key = np.concatenate([np.zeros(0, np.uint64), *items_key])
    level = np.concatenate([np.zeros(0, np.int64), *items_level])
    items = np.repeat(key, level)
    step = np.arange(len(items)) - np.repeat(np.cumsum(level) - level, level) + 1
    bits = max(64, -(-len(items) * BITS_PER_ITEM // 64) * 64)
    hit = np.zeros(bits, bool)
    for at in range(0, len(items), 1 << 18):
        hit[probe_bits(items[at:at + (1 << 18)], step[at:at + (1 << 18)], np.uint64(bits)).ravel().astype(np.int64)] = True
    return pa.RecordBatch.from_arrays([
        pa.array([part]), pa.array([words_key.tobytes()]), pa.array([words_count.tobytes()]), pa.array([np.packbits(hit).tobytes()])],
        names=["part", "keys", "counts", "bits"])


def fill_parts(least: int):
    return each_part(lambda part, rows: filled(part, met(rows), least))


ANSWERS = "chunk long, n int, part long, found binary, tokens long, vocabulary long"


def answer_parts(least: int, parts: int):
    """Fills each part's filter, unless it comes with the rows, and reads from it what the chunks ask: exact
    counts of words, levels of longer n-grams. One row more holds the part's tokens and distinct words."""
    def finish(part: int, rows: list) -> pa.RecordBatch:
        found = met(rows)
        ready = [pa.RecordBatch.from_pylist([{"part": part, "keys": r[3], "counts": r[4], "bits": r[5]}]) for r in rows if r[5] is not None]
        here = Parts(pa.Table.from_batches(ready or [filled(part, found, least)]), parts)
        out = [(-1, 0, b"", int(here.count.sum(dtype=np.int64)), len(here.key))]
        for n, (key, _, back, asked) in found.items():
            read = (here.exact(key).astype("<i8") if n == 1 else here.distinct_level(key, n))[back]
            at = 0
            for chunk, size in asked:
                out.append((chunk, n, by_byte(read[at:at + size]), 0, 0))
                at += size
        chunk, n, raw, tokens, vocabulary = zip(*out)
        return pa.RecordBatch.from_arrays([
            pa.array(chunk, pa.int64()), pa.array(n, pa.int32()), pa.array([part] * len(out), pa.int64()), pa.array(raw, pa.binary()),
            pa.array(tokens, pa.int64()), pa.array(vocabulary, pa.int64())], names=[c.split()[0] for c in ANSWERS.split(", ")])
    return each_part(finish)


@dataclass
class Model:
    """Where the parts are kept, which are gathered together on the driver, and the corpus totals."""

    table: DataFrame
    groups: list[list[int]]
    parts: int
    tokens: int
    vocabulary: int
    texts: int
    order: int
    least: int


def about_tokens(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\x20\x09-\x0D]")) + 1


def parts_for(tokens: int, order: int) -> int:
    return max(16, 1 << max(0, int(tokens * order // (2 * PART_ITEMS)).bit_length()))


def together(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(max(1, min(parts, partitions(rows.sparkSession))), "part").sortWithinPartitions("part")


def train(docs: DataFrame, text: str = "text", order: int = ORDER, least: int = LEAST_COUNT, send_mb: int = SEND_MB) -> Model:
    """Counts all n-grams of the texts. Null and empty texts are a lone end token; an empty
    table gives a model without words."""
    about, texts = docs.agg(F.sum(about_tokens(text)), F.count("*")).first()
    parts = parts_for(about or 0, order)
    rows = docs.select(F.col(text).alias("text")).mapInArrow(count_grams(order, parts), PACKED)
    table = saved(together(rows, parts).mapInArrow(fill_parts(least), "part long, keys binary, counts binary, bits binary"))
    sizes = table.select("part", F.length("bits").alias("b"), F.length("keys").alias("k")).collect()
    tokens = table.select("counts").mapInArrow(total_of, "total long").agg(F.sum("total")).first()[0] or 0
    need_of = lambda r: r.b + 2 * r.k  # noqa: E731  bits, word hashes and their counts
    whole = sum(map(need_of, sizes))
    room = -(-whole // max(1, -(-whole // (send_mb << 20)))) + max(map(need_of, sizes), default=0)  # as many groups, alike in size
    room = min(room, send_mb << 20)
    groups, held = [], room
    for r in sorted(sizes, key=lambda r: r.part):
        need = need_of(r)
        if not groups or held + need > room:
            groups.append([])
            held = 0
        groups[-1].append(r.part)
        held += need
    return Model(table, groups, parts, tokens, sum(r.k for r in sizes) // 8, texts, order, least)


def total_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(b, np.int64).sum()) for b in batch.column(0).to_pylist()], pa.int64())], names=["total"])


class Parts:
    """A group of parts: one run of bits, and sorted word counts. Built once, sent as arrays."""

    def __init__(self, table: pa.Table, parts: int):
        part = np.array(table.column("part"))
        size = np.array(pc.binary_length(table.column("bits")), np.int64) * 8
        self.parts = parts
        self.start, self.bits = np.zeros(parts, np.int64), np.zeros(parts, np.uint64)
        self.start[part], self.bits[part] = np.cumsum(size) - size, size
        whole = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(b.as_buffer(), kind) for b in table.column(name))])
        self.raw = whole("bits", np.uint8)
        key, count = whole("keys", np.uint64), whole("counts", np.int64)
        order = np.argsort(key)
        self.key, self.count = key[order], count[order]
        if len(count) and count.max() < 2**32:
            self.count = self.count.astype(np.uint32)

    def __getstate__(self) -> dict:
        """Arrays as bytes, which a worker reads once and looks at in place."""
        return {k: (v.dtype.str, v.tobytes()) if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}

    def __setstate__(self, state: dict) -> None:
        vars(self).update({k: np.frombuffer(v[1], v[0]) if isinstance(v, tuple) else v for k, v in state.items()})

    def level(self, gram: np.ndarray, n: int, limit: np.ndarray | None = None) -> np.ndarray:
        """Level of each n-gram whose part is here, 0 for the others, at most ``limit``, which equal
        n-grams share. Equal ones are read once."""
        part = self.part_of(gram)
        whole = np.zeros(len(gram), np.uint8)
        here = np.flatnonzero((self.bits[part] > 0) & (np.ones(1, bool) if limit is None else limit > 0))
        gram, at, back = np.unique(gram[here], return_index=True, return_inverse=True)
        whole[here] = self.distinct_level(gram, n, None if limit is None else limit[here[at]])[back]
        return whole

    def distinct_level(self, gram: np.ndarray, n: int, limit: np.ndarray | None = None) -> np.ndarray:
        """Level of each of n-grams that are all different and whose parts are here."""
        limit = np.full(len(gram), MAX_LEVEL) if limit is None else limit
        part, out, live = self.part_of(gram), np.zeros(len(gram), np.uint8), np.arange(len(gram))
        key = gram ^ words.mix(np.uint64([n]))
        for level in range(1, MAX_LEVEL + 1):
            if not len(live):
                break
            p = part[live]
            ok = np.ones(len(live), bool)
            a = words.mix(key[live] ^ words.mix(np.uint64([level])))
            b = words.mix(a) | np.uint64(1)
            for k in range(PROBES):
                at = bit_number(a + np.uint64(k) * b, self.bits[p]).astype(np.int64) + self.start[p]
                ok &= (self.raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                if k == 0 and not ok.all():  # most fail at once
                    live, p, a, b, ok = live[ok], p[ok], a[ok], b[ok], ok[ok]
            live = live[ok]
            out[live] = level
            live = live[limit[live] > level]
        return out

    def part_of(self, gram: np.ndarray) -> np.ndarray:
        return part_of(gram, self.parts)

    def exact(self, word: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.key, word), len(self.key) - 1)
        return np.where(self.key[at] == word, self.count[at], 0)


def sent_parts(model: Model, group: list[int]):
    rows = model.table.filter(F.col("part").isin(group) if len(model.groups) > 1 else F.lit(True)).toArrow()
    return model.table.sparkSession.sparkContext.broadcast(Parts(rows, model.parts))


class Answers:
    """What the parts sent back to a chunk: a value for each of its distinct n-grams, in order of their hashes."""

    def __init__(self, rows: pa.Table, parts: int):
        rows = rows.sort_by([("n", "ascending"), ("part", "ascending")])
        self.parts, self.found = parts, {}
        for n in pc.unique(rows.column("n")).to_pylist():
            mine = rows.filter(pc.field("n") == n).column("found").to_pylist()
            self.found[n] = np.concatenate([from_bytes(raw, "<i8" if n == 1 else "<u1") for raw in mine])

    def at(self, gram: np.ndarray, n: int) -> np.ndarray:
        return self.found[n][np.unique(gram, return_inverse=True)[1]]

    def exact(self, word: np.ndarray) -> np.ndarray:
        return self.at(word, 1)

    def level(self, gram: np.ndarray, n: int, limit: np.ndarray) -> np.ndarray:
        return np.minimum(self.at(gram, n), limit)

    def part_of(self, gram: np.ndarray) -> np.ndarray:
        return part_of(gram, self.parts)


def levels_at(parts: Parts | Answers, tokens: np.ndarray, counts: np.ndarray, exact: np.ndarray, old: list[np.ndarray] | None,
              order: int, least: int, texts: int, done: np.ndarray) -> list[np.ndarray]:
    """Levels of every order at each place: those found before, ``old``, and of the parts that are
    here. An n-gram is held to its suffix and context where the parts ``done`` so far know both."""
    first, got, below = first_words(counts), [], None
    for n in range(1, order + 1):
        gram = grams(tokens, counts, n)
        if n == 1:
            level = np.where(exact > 0, level_of(exact, 1), 0).astype(np.uint8)
        else:
            known = done[parts.part_of(below)]
            top = bounds(np.where(known, got[-1], MAX_LEVEL), first, n, least, texts).astype(np.uint8)
            level = parts.level(gram, n, top)
        if old is not None:
            level = np.maximum(level, old[n - 1])
        got.append(level if n == 1 else np.minimum(level, top))
        below = gram
    return got


def score_chunk(order: int, least: int, parts: int, totals: tuple[int, int, int]):
    """Scores a chunk's texts with the answers to it: the words' exact share of the base, and the model's probability."""
    n_all, vocabulary, n_texts = totals

    def run(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        words.give_back()
        tokens, counts = chunk_tokens(chunk)
        answers = Answers(rows, parts)
        exact = answers.exact(tokens)
        at = np.repeat(np.arange(len(counts)), counts)
        levels = levels_at(answers, tokens, counts, exact, None, order, least, n_texts, np.ones(parts, bool))
        base = np.bincount(at, np.log10((exact + ADD) / ADD), len(counts))
        base += counts * (math.log10(ADD) - math.log10(n_all + ADD * (vocabulary + 1)))
        score = np.bincount(at, np.log10(interpolated(levels, counts, least, *totals)), len(counts))
        known = np.bincount(at[exact > 0], minlength=len(counts))
        return pa.table([chunk.column("id"), pa.array(counts, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)],
                        names=[c.split()[0] for c in SCORED.split(", ")])
    return run


SCORED = "id long, n_tokens long, n_known long, base double, score double"


def interpolated(levels: list[np.ndarray], counts: np.ndarray, least: int, n_all: int, vocabulary: int, texts: int) -> np.ndarray:
    """Probability of every token. The context's count is the level of the n-gram one place
    before, one order down; a first word has the break as context, seen once in each text."""
    value = [value_of(n, least)[level] for n, level in enumerate(levels, 1)]
    p = (value[0] + ADD) / (max(n_all, 1) * 1.0 + ADD * (vocabulary + 1))
    first = first_words(counts)
    for n in range(2, len(levels) + 1):
        seen = value[n - 1]
        context = np.concatenate([[0.0], value[n - 2][:-1]])
        context = np.maximum(np.where(first, float(texts), context), seen)
        p = (seen + STRENGTH * p) / (context + STRENGTH)
    return np.minimum(p, 1.0)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, base, score`` of every row: log10 probabilities under additive
    smoothing of exact word counts and under the model.

    Null and empty texts are a lone end token; long texts are scored whole; repeated rows score alike;
    an empty table gives no rows; other columns are ignored.
    """
    tokens = docs.agg(F.sum(about_tokens(text))).first()[0] or 0
    texts = in_chunks(docs, doc_id, text, F.lit(False), tokens)
    asked = texts.groupBy("chunk").applyInArrow(ask(model.order, model.parts), PACKED)
    none = F.lit(-1).cast("long")
    ready = model.table.select("part", none.alias("chunk"), F.lit(0).alias("n"), none.alias("size"), "keys", "counts", "bits")
    answers = answered(asked.union(ready), model.least, model.parts)
    return scored(texts, answers, model.order, model.least, model.parts, (model.tokens, model.vocabulary, model.texts))


def in_chunks(docs: DataFrame, doc_id: str, text: str, learn: Column, tokens: int) -> DataFrame:
    """``chunk, id, text, learn``: texts dealt by what they hold, so that each is in the same chunk whenever it is read."""
    chunks = max(1, -(-tokens // CHUNK_TOKENS), min(docs.sparkSession.sparkContext.defaultParallelism, -(-tokens // TASK_TOKENS)))
    out = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return out.select(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk"), "id", "text", "learn")


def answered(rows: DataFrame, least: int, parts: int) -> DataFrame:
    return saved(together(rows, parts).mapInArrow(answer_parts(least, parts), ANSWERS), **STATE_FILES)


def scored(texts: DataFrame, answers: DataFrame, order: int, least: int, parts: int, totals: tuple[int, int, int]) -> DataFrame:
    rows = answers.filter("n > 0").select("chunk", "n", "part", "found")
    return texts.select("chunk", "id", "text").groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(score_chunk(order, least, parts, totals), SCORED)


def score_held_out(docs: DataFrame, fold: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER,
                   least: int = LEAST_COUNT) -> DataFrame:
    """Scores all rows under a model of those for which ``fold`` is not 0. The chunks' n-grams are counted
    and looked up where they meet; results are those of ``train`` and ``score``."""
    about = about_tokens(text)
    tokens, learnt, n_texts = docs.agg(F.sum(about), F.sum(F.when(fold != 0, about)), F.count_if(fold != 0)).first()
    parts = parts_for(learnt or 0, order)
    texts = in_chunks(docs, doc_id, text, fold != 0, tokens or 0)
    answers = answered(texts.groupBy("chunk").applyInArrow(ask(order, parts), PACKED), least, parts)
    n_all, vocabulary = (x or 0 for x in answers.filter("n = 0").agg(F.sum("tokens"), F.sum("vocabulary")).first())
    out = scored(texts, answers, order, least, parts, (n_all, vocabulary, n_texts)).withColumn("train_tokens", F.lit(n_all).cast("long"))
    return out.select(F.col("id").alias(doc_id), "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"), "score")
