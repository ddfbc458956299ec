"""Alignment of two tokenizers over the same texts.

Both tokenizers cut a text, with a space before it, into tokens that end at byte offsets.
Offsets where both end a token part the tokens into groups, and the tokens of a group are
linked each with each. ``common_ends`` walks the two arrays of ends at a fixed index shift as
long as tokens stand one to one, probing twice as far each time, and steps token by token
only inside an irregular group, which sets the next shift.

No token of either goes on over a single space (B's vocabulary has none, A's pre-tokeniser cuts
there), so a text is handled as segments that start at such spaces. A task aligns each distinct segment once.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterqa.llm import words
from rasterqa.llm.common import saved

#: Segments kept by one task; the store is emptied beyond that.
STORE = 300_000
#: Pairs with their counts that are broadcast at most (13 bytes each); more are joined by a shuffle.
SEND_PAIRS = 4_000_000
#: Pairs of texts that are gathered before they are counted.
HELD_PAIRS = 1 << 21
#: Links of one step while they are being spread out.
SPREAD = 1 << 20
#: Tokens of a run that are compared one by one before whole slices are.
PROBE = 4
LOW = np.int64(0xFFFFFFFF)
#: How byte-level vocabularies spell bytes: printable ones as themselves, the
#: others, in order, from U+0100 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(PLAIN)))}
#: Fixed value: where byte-level vocabularies cut a text before they merge.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTES = {c: b for b, c in SPELLED.items()}


def common_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of ``a`` and of ``b`` that end together; both end at the same place."""
    starts: list[tuple[int, int, int]] = []
    n = len(a)
    a, b = [*a, -1], [*b, -2]  # never equal: a walk ends there
    i = j = 0
    while i < n:
        far = i
        d = j - i
        while far < i + PROBE and a[far] == b[far + d]:
            far += 1
        if far == i + PROBE:
            step = PROBE
            while far + step <= n and a[far:far + step] == b[far + d:far + d + step]:
                far, step = far + step, 2 * step
            while step > 1:
                step //= 2
                if far + step <= n and a[far:far + step] == b[far + d:far + d + step]:
                    far += step
        if far > i:
            starts.append((i, j, far - i))
            i, j = far, far + d
        if i < n:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            starts.append((i, j, 1))
            i, j = i + 1, j + 1
    at = np.array(starts, np.int64).reshape(-1, 3)
    inner = np.arange(at[:, 2].sum()) - np.repeat(np.cumsum(at[:, 2]) - at[:, 2], at[:, 2])
    return np.repeat(at[:, 0], at[:, 2]) + inner, np.repeat(at[:, 1], at[:, 2]) + inner


def spread(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the stretches of these lengths."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def weighed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their weights."""
    found, at = np.unique(key, return_inverse=True)
    return found, np.bincount(at, weight, len(found)).astype(np.int64)


def links_of(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, pair (A id above B id, 32 bits each) and number of links of each distinct pair of
    an owner. ``ga`` and ``gb`` number the groups of the tokens, ``owner`` owns the groups."""
    n_a, n_b = np.bincount(ga, minlength=len(owner)), np.bincount(gb, minlength=len(owner))
    one = (n_a == 1) & (n_b == 1)
    in_a, in_b = one[ga], one[gb]
    ka, wa = weighed((ga[~in_a] << 32) | a[~in_a], np.ones(len(a) - in_a.sum()))
    kb, wb = weighed((gb[~in_b] << 32) | b[~in_b], np.ones(len(b) - in_b.sum()))
    n_b = np.bincount(kb >> 32, minlength=len(owner))
    first = np.cumsum(n_b) - n_b
    n = n_b[ka >> 32]
    upto = np.cumsum(n)
    rows = [(owner[one], (a[in_a] << 32) | b[in_b], np.ones(int(one.sum()), np.int64))]
    for lo in range(0, int(upto[-1]) if len(upto) else 0, SPREAD):
        k = np.arange(lo, min(lo + SPREAD, int(upto[-1])))
        x = np.searchsorted(upto, k, side="right")
        y = first[ka[x] >> 32] + k - (upto[x] - n[x])
        rows.append((owner[ka[x] >> 32], ((ka[x] & LOW) << 32) | (kb[y] & LOW), wa[x] * wb[y]))
    who, pair, weight = (np.concatenate(c) for c in zip(*rows))
    order = np.lexsort((pair, who))
    who, pair, weight = who[order], pair[order], weight[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return who[at], pair[at], np.add.reduceat(weight, at) if len(at) else weight


class Tokens:
    """The two tokenizers: ids of a segment, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(BYTES[c] for c in piece) if all(c in BYTES for c in piece) else piece.encode()
        self.b_bytes = [self.piece(i) for i in range(self.b.get_piece_size())]
        self.fast = self.ranked(a_path)
        self.bytes = (self.a_bytes, self.b_bytes)
        self.size = tuple(np.array(list(map(len, x)), np.int64) for x in self.bytes)
        #: an id with what follows it in writing: within a group, at the end of its A side and of its B side
        self.signs = [f"{i}{c}".encode() for i in range(max(map(len, self.bytes))) for c in (",", "|", ";", "")]
        self.sign_size = np.array(list(map(len, self.signs)), np.int64)
        if any(b" " in p.lstrip(b" ") for p in self.b_bytes) or len(self.a.pre_tokenizer.pre_tokenize_str("a b")) != 2:
            raise ValueError("a token goes on over a space: texts can't be cut there")

    def ranked(self, path: str):
        """A faster encoder of the same vocabulary, if ids are numbered as merges were learned: then
        merging by pairs and merging by the rank of what results are the same."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {b: i for i, b in enumerate(self.a_bytes) if i < 256 + len(merges)}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def piece(self, i: int) -> bytes:
        text = self.b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if self.b.is_byte(i) else text.replace("▁", " ").encode()

    def encode_a(self, segments: list[bytes], joined: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids under A end to end, and their number in each segment. The first ``joined`` segments end in
        no white space, so that A cuts between them and they are one text."""
        raw = b"".join(segments[:joined])
        if self.fast is None or not joined:
            joined, ids = 0, np.zeros(0, np.int64)
        else:
            ids = self.fast.encode_to_numpy(raw.decode("utf-8", "replace"), disallowed_special=()).astype(np.int64)
        ends = np.cumsum(self.size[0][ids])
        if joined and ends[-1] != len(raw):  # not UTF-8
            joined, ids, ends = 0, ids[:0], ends[:0]
        stop = np.searchsorted(ends, np.cumsum(list(map(len, segments[:joined]))), side="right")
        rest = [self.a.encode(s.decode("utf-8", "replace"), add_special_tokens=False).ids for s in segments[joined:]]
        more, n = flat(rest)
        return np.concatenate([ids, more]), np.concatenate([np.diff(stop, prepend=0), n])

    def encode_b(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_a``, under B, which puts the space itself."""
        return flat(self.b.encode([s[1:].decode("utf-8", "replace") for s in segments], num_threads=1))


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids end to end, and the number of ids of each list."""
    return np.array(list(chain.from_iterable(ids)), np.int64), np.array(list(map(len, ids)), np.int64)


class Store:
    """Distinct segments with their tokens, groups and links.

    Of slot ``s``: ``whole[s]`` whether its tokens spell it, ``sizes[s]`` its A tokens, B tokens,
    groups and links, ``text[s]`` its groups in writing, and from ``first[s]`` on ``width[s]``
    distinct links, as places in ``pairs``, with their ``weight``.
    """

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.place: dict[int, int] = {}
        self.pairs = array("q")
        self.text: list[bytes] = []
        self.whole = array("b")
        self.sizes = [array("q") for _ in range(4)]
        self.first, self.width, self.link, self.weight = (array("q") for _ in range(4))

    def slots(self, segments: np.ndarray, raw: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slots of segments given by hash and byte range; new ones are added."""
        found, where, at = np.unique(segments, return_index=True, return_inverse=True)
        keys = found.tolist()
        slots = list(map(self.slot.get, keys))
        new = [i for i, s in enumerate(slots) if s is None]
        if new:
            size = len(self.whole)
            added = [raw[first[where[i]]:end[where[i]]] for i in new]
            odd = [not 32 < s[-1] < 127 for s in added]
            order = [k for k, x in enumerate(odd) if not x] + [k for k, x in enumerate(odd) if x]
            self.add([added[k] for k in order], len(odd) - sum(odd))
            for n, k in enumerate(order):
                slots[new[k]] = self.slot[keys[new[k]]] = size + n
        return np.array(slots, np.int64)[at]

    def add(self, segments: list[bytes], joined: int) -> None:
        a, b = self.tokens.encode_a(segments, joined), self.tokens.encode_b(segments)
        (ids_a, n_a), (ids_b, n_b), whole = a, b, np.ones(len(segments), bool)
        if not (self.spells(0, ids_a, n_a, segments) and self.spells(1, ids_b, n_b, segments)):
            for names, (ids, n) in zip(self.tokens.bytes, (a, b)):
                pieces, upto = list(map(names.__getitem__, ids.tolist())), np.cumsum(n).tolist()
                whole &= [b"".join(pieces[x:y]) == s for x, y, s in zip([0, *upto], upto, segments)]
            ids_a, ids_b = ids_a[np.repeat(whole, n_a)], ids_b[np.repeat(whole, n_b)]
            n_a, n_b = n_a * whole, n_b * whole
        ia, ib = common_ends(np.cumsum(self.tokens.size[0][ids_a]).tolist(), np.cumsum(self.tokens.size[1][ids_b]).tolist())
        owner = np.searchsorted(np.cumsum(n_a), ia, side="right")
        groups = np.bincount(owner, minlength=len(segments))
        len_a, len_b = np.diff(ia, prepend=-1), np.diff(ib, prepend=-1)
        ga, gb = np.repeat(np.arange(len(ia)), len_a), np.repeat(np.arange(len(ib)), len_b)
        who, pair, weight = links_of(ids_a, ids_b, ga, gb, owner)
        links = np.bincount(owner, (len_a * len_b).astype(np.float64), len(segments)).astype(np.int64)
        self.text += self.written(ids_a, ids_b, ia, ib, np.cumsum(groups))
        self.whole.extend(whole.tolist())
        for col, v in zip(self.sizes, (n_a, n_b, groups, links)):
            col.extend(v.tolist())
        width = np.bincount(who, minlength=len(segments))
        self.first.extend((len(self.link) + np.cumsum(width) - width).tolist())
        self.width.extend(width.tolist())
        self.weight.extend(weight.tolist())
        found, at = np.unique(pair, return_inverse=True)
        place = []
        for p in found.tolist():
            known = self.place.setdefault(p, len(self.pairs))
            if known == len(self.pairs):
                self.pairs.append(p)
            place.append(known)
        self.link.extend(np.array(place, np.int64)[at].tolist())

    def spells(self, k: int, ids: np.ndarray, counts: np.ndarray, segments: list[bytes]) -> bool:
        """Whether the tokens of every segment spell it."""
        size = sum_by_text(self.tokens.size[k][ids], counts)
        return size.tolist() == [len(s) for s in segments] and b"".join(map(self.tokens.bytes[k].__getitem__, ids.tolist())) == b"".join(segments)

    def written(self, ids_a: np.ndarray, ids_b: np.ndarray, ia: np.ndarray, ib: np.ndarray, upto: np.ndarray) -> list[bytes]:
        """The groups of each segment in writing; segments end at the groups ``upto``."""
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[ia], last_b[ib] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        sign = np.empty(len(ids_a) + len(ids_b), np.int64)
        sign[np.arange(len(ids_a)) + np.concatenate(([0], ib + 1))[group_a]] = 4 * ids_a + last_a
        sign[np.arange(len(ids_b)) + (ia + 1)[group_b]] = 4 * ids_b + 2 * last_b
        ends = np.concatenate(([0], np.cumsum(self.tokens.sign_size[sign])))
        n = np.concatenate(([0], np.cumsum(np.diff(ia, prepend=-1) + np.diff(ib, prepend=-1))))[upto]
        stop = ends[n].tolist()
        raw = b"".join(map(self.tokens.signs.__getitem__, sign.tolist()))
        return [raw[lo:max(lo, hi - 1)] for lo, hi in zip([0, *stop], stop)]


@cache
def worker_store(a_path: str, b_path: str) -> Store:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Store(Tokens(a_path, b_path))


def store(a_path: str, b_path: str) -> Store:
    """One store per Python worker, which lives through many tasks."""
    kept = worker_store(a_path, b_path)
    if len(kept.whole) > STORE:
        kept.clear()
    return kept


def segments_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a space before each, end to end; hash, first byte and end of their segments,
    and each text's number of segments.

    A segment starts at a space that follows a byte which ends no white space and goes
    before anything but a space.
    """
    raw = b"".join(b" " + t for t in texts)
    c = np.frombuffer(raw, np.uint8)
    stop = np.cumsum([len(t) + 1 for t in texts])
    before, two = np.concatenate((c[:1], c[:-1])), np.concatenate((c[:1], c[:1], c[:-2]))[:len(c)]
    after = np.concatenate((c[1:], c[:1]))
    # characters of white space beyond ASCII have one of these bytes last but one
    odd = (two == 0xC2) | (two == 0x80) | (two == 0x81) | (two == 0x9A)
    cut = (c == 32) & (after != 32) & (((before > 32) & (before < 127)) | ((before >= 128) & ~odd))
    cut[np.concatenate(([0], stop[:-1]))] = True
    first = np.flatnonzero(cut)
    end = np.append(first[1:], len(c))
    place = np.arange(len(c)) - np.repeat(first, end - first)
    value = words.BYTE_AT[(place % words.TABLE_DEPTH) * 256 + c]
    far = place >= words.TABLE_DEPTH
    if far.any():
        value = np.where(far, words.mix(value ^ place.astype(np.uint64)), value)
    counts = np.diff(np.searchsorted(first, stop), prepend=0)
    return raw, words.mix(np.add.reduceat(value, first)), first, end, counts


def sum_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(values)))
    end = np.cumsum(counts)
    return upto[end] - upto[end - counts]


def read_chunks(batches: Iterator[pa.RecordBatch], column: int, kept: Store):
    """Batch, range of its rows, places of the rows with tokens, their slots and numbers of segments."""
    for batch in words.slices(batches):
        texts = words.texts(batch.column(column))
        for lo, hi in words.chunks(texts):
            some = [i for i in range(lo, hi) if texts[i]]
            slots, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if some:
                raw, h, first, end, counts = segments_of([texts[i] for i in some])
                slots = kept.slots(h, raw, first, end)
                whole = sum_by_text(1 - np.array(kept.whole, np.int64)[slots], counts) == 0
                slots, counts = slots[np.repeat(whole, counts)], counts[whole]
                some = [i for i, w in zip(some, whole.tolist()) if w]
            yield batch, lo, hi, np.array(some, np.int64) - lo, slots, counts


def distinct_links(kept: Store, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in ``pairs`` and number of links of each distinct pair of a text."""
    text = np.repeat(np.arange(len(counts)), counts)
    key, times = np.unique((text << 32) | slots, return_counts=True)
    text, slot = key >> 32, key & LOW
    width = np.array(kept.width, np.int64)[slot]
    at = np.repeat(np.array(kept.first, np.int64)[slot], width) + spread(width)
    key, weight = weighed((np.repeat(text, width) << 32) | np.array(kept.link, np.int64)[at], np.array(kept.weight, np.int64)[at] * np.repeat(times, width))
    return key >> 32, key & LOW, weight


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts that hold each pair linked, as far as the task has seen them."""
    pairs, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def counted() -> tuple[np.ndarray, np.ndarray]:
        found, times = np.unique(np.concatenate(held), return_counts=True) if held else (pairs[:0], n[:0])
        return weighed(np.concatenate([pairs, found]), np.concatenate([n, times]))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    for batch in batches:
        held += [np.frombuffer(b.as_buffer(), "<i8") for b in batch.column(0)]
        size += sum(map(len, held[-batch.num_rows:])) if batch.num_rows else 0
        if size > HELD_PAIRS:
            pairs, n = counted()
            held, size = [], 0
            if len(pairs) > HELD_PAIRS:
                yield out()
                pairs, n = pairs[:0], n[:0]
    pairs, n = counted()
    yield out()


def doc_columns(kept: Store, ids: pa.Array, at: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """Id, sizes and written groups of a chunk's rows."""
    n = len(ids)
    cols = []
    for size in kept.sizes:
        v = np.zeros(n, np.int64)
        v[at] = sum_by_text(np.array(size, np.int64)[slots], counts)
        cols.append(pa.array(v))
    written = [""] * n
    names, upto = slots.tolist(), 0
    for i, c in zip(at.tolist(), counts.tolist()):
        written[i] = b";".join([kept.text[s] for s in names[upto:upto + c]]).decode()
        upto += c
    return [ids.cast(pa.int64()), *cols, pa.array(written, pa.string())]


DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
DOC_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"


def linked_docs(a_path: str, b_path: str):
    """Rows of the texts with their distinct pairs and the numbers of links, both packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = store(a_path, b_path)
        for batch, lo, hi, at, slots, counts in read_chunks(batches, 1, kept):
            text, pair, weight = distinct_links(kept, slots, counts)
            upto = np.zeros(hi - lo + 1, np.int64)
            upto[at + 1] = np.bincount(text, minlength=len(at))
            cuts = (8 * np.cumsum(upto)).tolist()
            packed = [v.astype("<i8").tobytes() for v in (np.array(kept.pairs, np.int64)[pair], weight)]
            cols = doc_columns(kept, batch.column(0).slice(lo, hi - lo), at, slots, counts)
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([raw[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary()) for raw in packed)],
                                             names=[*DOC, "pairs", "links"])
            if len(kept.whole) > STORE:
                kept.clear()
    return run


def unpacked(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and links of the rows ``lo`` to ``hi`` end to end, and the number of each row's."""
    raw = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo).to_pylist() for c in ("pairs", "links")]
    pair, links = (np.frombuffer(b"".join(r), "<i8") for r in raw)
    return pair, links, np.array([len(r) // 8 for r in raw[0]], np.int64)


def score_rows(sent):
    """The rows with the sums over their links, from the broadcast counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            sums = [[np.zeros(0, np.int64)] for _ in range(2)]
            for lo in range(0, batch.num_rows, 1000):
                pair, links, counts = unpacked(batch, lo, min(lo + 1000, batch.num_rows))
                k = np.searchsorted(pairs, pair)
                for col, v in zip(sums, (best, n)):
                    col.append(sum_by_text(v[k] * links, counts))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(DOC))), *(pa.array(np.concatenate(v)) for v in sums)],
                                             names=[*DOC, "n_best", "count_sum"])
    return run


def spread_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct pair of a row."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            pair, links, counts = unpacked(batch, lo, min(lo + 1000, batch.num_rows))
            row = batch.column(0).take(pa.array(lo + np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([row, pa.array(pair), pa.array(links)], names=["row", "pair", "links"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many rows an A and a B id are linked, and whether no other pair
    of the A id is in more. ``pair`` has the A id in its upper 32 bits."""
    seen = rows.select("pairs").mapInArrow(count_pairs, "pair long, n long")
    counts = saved(seen.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(documents: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
                     send_pairs: int = SEND_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum``: how tokenizer A (byte-level,
    a ``tokenizers`` file) and B (a ``sentencepiece`` model with byte fallback) cut each text.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3``. ``n_best`` are the links whose pair is in
    most texts among those of its A id, ties included; ``count_sum`` adds up the pairs' counts.
    Null and empty texts, and texts that the tokens of A or B do not spell byte by byte, have zeros and an
    empty string. Repeated rows count and appear as documents of their own; an empty table gives no
    rows; other columns are ignored.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # each text is cut and aligned once; what is counted and summed up later is read from here
    rows = saved(docs.mapInArrow(linked_docs(a_path, b_path), f"{DOC_DDL}, pairs binary, links binary").withColumn("row", F.expr("uuid()")), compression="zstd")
    counts = saved(pair_counts(rows))
    if counts.count() <= send_pairs:
        table = counts.toArrow().sort_by("pair")
        sent = tuple(np.array(table.column(c).combine_chunks().cast(t)) for c, t in (("pair", pa.int64()), ("n", pa.int64()), ("best", pa.int8())))
        spark = docs.sparkSession
        out = rows.drop("row").mapInArrow(score_rows(spark.sparkContext.broadcast(sent)), f"{DOC_DDL}, n_best long, count_sum long")
    else:
        links = rows.select("row", "pairs", "links").mapInArrow(spread_links, "row string, pair long, links long")
        sums = links.join(counts, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
        out = rows.join(sums, "row", "left").select(*DOC, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")])
    return out.withColumnRenamed("doc_id", doc_id)
