"""Periodic runs in word sequences, found on a grammar.

The word ids of a chunk of texts are compressed by Re-Pair: the most frequent pairs become
nonterminals, round by round, until no pair occurs twice; what is left of each text is
paired up level by level. Each nonterminal stands for one stretch of words with one inner
boundary. A run lies across the boundary of the smallest nonterminal that holds it, so the
runs across each boundary are found once per nonterminal, carried to all the places where
the nonterminal is derived, and stretches that lie in a longer one of the same period go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterqa.llm import words

EXPONENT = 4
LEAST = 6
#: (boundary, period) pairs that are compared at once.
PAIRS = 1 << 19
MULTIPLIER = np.uint64(0x9E3779B97F4A7C55)
RUN_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


@dataclass
class Grammar:
    """Rules of a chunk. Symbols below ``terminals`` are words; rule ``i`` is symbol
    ``terminals + i`` and stands first at ``at[i]``, its boundary is ``mid[i]``, its end ``end[i]``."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    at: np.ndarray
    mid: np.ndarray
    end: np.ndarray
    roots: np.ndarray
    places: np.ndarray


def first_of_group(key: np.ndarray) -> np.ndarray:
    """For each element the index at which its stretch of equal neighbours begins."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def re_pair(ids: np.ndarray, counts: np.ndarray, terminals: int) -> Grammar:
    """Grammar of the texts whose word ids lie end to end in ``ids``, ``counts`` words each.

    A round replaces every pair that occurs twice or more and is more frequent than the pairs
    it overlaps (ties by the pair itself; of equal neighbours every other one). A pair seen once
    never repeats later, so only pairs that repeat are looked at again.
    """
    seq, at = ids.astype(np.int64), np.arange(len(ids))
    size = np.ones(len(ids), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    known, known_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rules: list[tuple[np.ndarray, ...]] = []
    top = terminals

    def replace(wins: np.ndarray, symbol: np.ndarray) -> None:
        nonlocal seq, at, size, doc
        size[wins] += size[wins + 1]
        seq[wins] = symbol
        stay = np.ones(len(seq), bool)
        stay[wins + 1] = False
        seq, at, size, doc = seq[stay], at[stay], size[stay], doc[stay]

    def add(wins: np.ndarray) -> np.ndarray:
        """New rules of the pairs at these places."""
        nonlocal top
        rules.append((seq[wins], seq[wins + 1], at[wins], at[wins] + size[wins], at[wins] + size[wins] + size[wins + 1]))
        top += len(wins)
        return np.arange(top - len(wins), top)

    live = np.flatnonzero(doc[1:] == doc[:-1])
    while len(live):
        code = (seq[live] << 32) | seq[live + 1]
        pair, inverse, n = np.unique(code, return_inverse=True, return_counts=True)
        rank = np.empty(len(pair), np.int64)
        rank[np.lexsort((words.mix(pair.view(np.uint64)), n))] = np.arange(len(pair))
        keep = n[inverse] > 1
        live, code, rank, inverse = live[keep], code[keep], rank[inverse[keep]], inverse[keep]
        if not len(live):
            break
        beside = np.diff(live) == 1
        stretch = np.cumsum(np.concatenate(([0], ~(beside & (code[1:] == code[:-1])))))
        score = 2 * rank + 1 - (np.arange(len(live)) - first_of_group(stretch)) % 2
        win = np.ones(len(live), bool)
        win[1:] &= ~beside | (score[1:] > score[:-1])
        win[:-1] &= ~beside | (score[:-1] > score[1:])
        wins, wcode = live[win], code[win]
        wpair, first, where = np.unique(wcode, return_index=True, return_inverse=True)
        slot = np.searchsorted(known, wpair)
        old = slot < len(known)
        old[old] = known[slot[old]] == wpair[old]
        symbol = np.empty(len(wpair), np.int64)
        symbol[old] = known_id[slot[old]]
        symbol[~old] = add(wins[first[~old]])
        known, known_id = np.insert(known, slot[~old], wpair[~old]), np.insert(known_id, slot[~old], symbol[~old])
        gone = np.zeros(len(seq) + 1, bool)
        gone[wins + 1] = True
        shift = np.cumsum(gone)
        #: a boundary inside a replaced pair is gone, one whose left word was swallowed moves to the new symbol
        rest = live[~win]
        replace(wins, symbol[where])
        live = rest - shift[rest]
    while True:
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        if not len(pair):
            break
        place = np.arange(len(doc)) - first_of_group(doc)
        wins = pair[place[pair] % 2 == 0]
        replace(wins, add(wins))
    none = np.zeros(0, np.int64)
    left, right, start, mid, end = (np.concatenate(c) for c in zip(*rules)) if rules else (none,) * 5
    return Grammar(terminals, left, right, start, mid, end, seq, at)


class Stretches:
    """Equality of stretches of words by their hash sums, and how far it reaches."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.power = np.ones(n + 1, np.uint64)
        self.power[1:] = MULTIPLIER
        self.power = np.multiply.accumulate(self.power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.power[:n], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``a`` equal those from ``b``; a <= b."""
        return (self.sums[a + length] - self.sums[a]) * self.power[b - a] == self.sums[b + length] - self.sums[b]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from (``back``: up to) ``a`` and ``b`` agree, at most ``most``."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while len(a) and (low < high).any():
            half = (low + high + 1) // 2
            off = half if back else 0
            same = self.equal(a - off, b - off, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low


def boundary_runs(h: np.ndarray, g: Grammar, exponent: int, least: int):
    """Rule, first word, end and period of the stretches across each rule's boundary, as far as
    they lie in the rule."""
    text = Stretches(h)
    widest = (g.end - g.at) // exponent
    upto = np.cumsum(widest)
    out = []
    for lo in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        k = np.arange(lo, min(lo + PAIRS, int(upto[-1])))
        rule = np.searchsorted(upto, k, side="right")
        q = k - (upto[rule] - widest[rule]) + 1
        l, b, r = g.at[rule], g.mid[rule], g.end[rule]
        # a stretch of four periods or more has two whole ones on a side of the boundary
        fits = b + 2 * q <= r
        right, rq = rule[fits], q[fits]
        on = text.equal(b[fits], b[fits] + rq, rq)
        fits = b - 2 * q >= l
        left, lq = rule[fits], q[fits]
        off = text.equal(b[fits] - 2 * lq, b[fits] - lq, lq)
        hit = np.unique(np.concatenate([(right[on] << 32) | rq[on], (left[off] << 32) | lq[off]]))
        rule, q = hit >> 32, hit & 0xFFFFFFFF
        l, b, r = g.at[rule], g.mid[rule], g.end[rule]
        for start in (b, b - 2 * q):
            ok = (start >= l) & (start + 2 * q <= r)
            ok[ok] = text.equal(start[ok], start[ok] + q[ok], q[ok])
            rr, s, p, left, right = rule[ok], start[ok], q[ok], l[ok], r[ok]
            e = s + p + text.reach(s, s + p, right - s - p, False) if len(s) else s
            s = s - text.reach(s, s + p, s - left, True) if len(s) else s
            cross = (s < g.mid[rr]) & (e > g.mid[rr]) & (e - s >= np.maximum(least, exponent * p))
            out.append(np.stack([rr[cross], s[cross], e[cross], p[cross]]))
    found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    # of the periods of one stretch the others are multiples of the least
    found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:3, 1:] != found[:3, :-1]).any(axis=0)
    return exact(h, g, found[:, new], exponent, least)


def exact(h: np.ndarray, g: Grammar, found: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Hash sums can only agree too often: each stretch is read once word by word, and one
    that does not hold is replaced by what holds across that boundary."""
    sound = np.array([np.array_equal(h[s:e - q], h[s + q:e]) for _, s, e, q in found.T.tolist()], bool)
    if sound.all():
        return found
    more = []
    for rule, _, _, q in found[:, ~sound].T.tolist():
        l, b, r = int(g.at[rule]), int(g.mid[rule]), int(g.end[rule])
        edge = np.concatenate(([-1], np.flatnonzero(h[l:r - q] != h[l + q:r]), [r - q - l]))
        s, e = l + edge[:-1] + 1, l + edge[1:] + q
        for i in np.flatnonzero((s < b) & (e > b) & (e - s >= max(least, exponent * q))):
            more.append((rule, s[i], e[i], q))
    return np.concatenate([found[:, sound], np.array(more, np.int64).reshape(-1, 4).T], axis=1)


def derived(g: Grammar, found: np.ndarray) -> np.ndarray:
    """The found stretches at every place where their rule is derived: start, end, period."""
    count = np.bincount(found[0], minlength=len(g.left))
    first = np.cumsum(count) - count
    found = found[:, np.argsort(found[0], kind="stable")]
    holds = count > 0
    below = lambda side: (side >= g.terminals) & holds[np.maximum(side - g.terminals, 0)]
    while True:  # rules that derive a rule with runs; a level of the grammar a turn
        new = holds | below(g.left) | below(g.right)
        if np.array_equal(new, holds):
            break
        holds = new
    symbol, at = g.roots, g.places
    out = []
    while True:
        inner = symbol >= g.terminals
        rule, at = symbol[inner] - g.terminals, at[inner]
        rule, at = rule[holds[rule]], at[holds[rule]]
        if not len(rule):
            break
        n = count[rule]
        k = np.repeat(first[rule] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shift = np.repeat(at - g.at[rule], n)
        out.append(np.stack([found[1, k] + shift, found[2, k] + shift, found[3, k]]))
        symbol = np.concatenate([g.left[rule], g.right[rule]])
        at = np.concatenate([at, at + g.mid[rule] - g.at[rule]])
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


def maximal(spans: np.ndarray) -> np.ndarray:
    """Without stretches inside another of the same period, and without multiples of a period."""
    s, e, q = spans
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    if not len(s):
        return spans
    group = q * (int(e.max()) + 1)
    before = np.maximum.accumulate(group + e)
    keep = np.ones(len(s), bool)
    keep[1:] = (q[1:] != q[:-1]) | (group[1:] + e[1:] > before[:-1])
    s, e, q = s[keep], e[keep], q[keep]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return np.stack([s[keep], e[keep], q[keep]])


def runs_of(h: np.ndarray, counts: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Start, end and period of the runs of the texts whose words lie end to end, by start."""
    found, ids = np.unique(h, return_inverse=True)
    g = re_pair(ids, counts, len(found))
    spans = maximal(derived(g, boundary_runs(h, g, exponent, least)))
    return spans[:, np.lexsort((spans[2], spans[0]))]


def run_rows(exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            ids, texts = batch.column(0), words.texts(batch.column(1))
            for lo, hi in words.chunks(texts):
                h, _, _, counts = words.word_hashes(texts[lo:hi])
                s, e, q = runs_of(h, counts, exponent, least)
                base = np.cumsum(counts) - counts
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, s + q, 1)
                np.add.at(edge, e, -1)
                stay = np.cumsum(edge[:-1]) == 0
                cut = np.searchsorted(s, np.append(base, len(h)))
                kept = []
                for i, text in enumerate(texts[lo:hi]):
                    w = text.split()
                    if cut[i + 1] > cut[i]:
                        w = [w[k] for k in np.flatnonzero(stay[base[i]:base[i] + counts[i]])]
                    kept.append(b" ".join(w))
                at = np.repeat(base, np.diff(cut))
                item = pa.StructArray.from_arrays([pa.array(s - at), pa.array(e - s), pa.array(q)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), item), pa.array(kept, pa.binary()),
                ], names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(documents: DataFrame, exponent: int = EXPONENT, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the maximal stretches of words that repeat with a
    smallest period q over ``max(least, exponent * q)`` words or more, by start and period, and
    the words that lie in no run after its first period, joined by spaces (UTF-8 bytes).

    ``exponent`` is 4 or more. Null and empty texts have no words and no runs; repeated rows give
    a row each; a null id stays null; an empty table gives no rows; other columns are ignored.
    """
    if exponent < 4:
        raise ValueError("a shorter run may lack two whole periods on one side of a boundary")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run_rows(exponent, least), RUN_DDL).withColumnRenamed("doc_id", doc_id)
