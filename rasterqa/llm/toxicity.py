"""Toxicity of texts behind a noisy channel.

Words that hide their letters (digits and signs for letters, stretched letters, letters
spaced out) are decoded: a lattice holds what each character may stand for, and Viterbi's
algorithm takes the path that a character language model finds likeliest. Between characters that
stand alone the lattice may end a word or drop the break. The restored words are scored with the
others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterqa.llm import words
from rasterqa.llm.common import crc_fold, saved
from rasterqa.llm.substrings import bitmap, marked

#: Likelihood ratio (G squared) that a word or prefix must reach.
EVIDENCE = 30.0
PREFIXES = (4, 5)
FOLDS = 5

# What a character may stand for; fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou",
}
#: Characters that may also stand for nothing.
DROPPABLE = set("!|+*#%&^~$@")
SIGN_COST, DROP_COST = 1.0, 2.0
#: Log-likelihood that a word break is given where breaks are favoured.
BREAK_GAIN = 4.0
BREAK = bytes.maketrans(b".,;:?\"'()[]{}<>-_/\\=`", b" " * 21)
SIGNS = np.zeros(256, bool)
SIGNS[list(b"0123456789@$!|+*#%&^~")] = True
EDGES = re.compile(r"^[@$!|+*#%&^~]+|[@$!|+*#%&^~]+$")
SPACED_LEAST = 3
#: Hidden words kept with their reading by one task.
MEMORY = 100_000


@dataclass
class Model:
    """Weights of word and prefix hashes, the character model, and the final logistic curve."""

    keys: np.ndarray
    weights: np.ndarray
    letters: dict[str, float]
    unseen: float
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)


class Decoder:
    """Readings of hidden words under a character trigram model."""

    def __init__(self, letters: dict[str, float], unseen: float):
        self.letters, self.unseen, self.known = letters, unseen, {}

    def __call__(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = self.known[token] = " ".join(self.readings(token))
        return found

    def readings(self, token: str) -> list[str]:
        """The reading of a hidden word. A run of characters set apart by single spaces is read in two
        ways, by the model alone and with word breaks favoured ("ave..." or "a ve..."); and as its
        first or last character may be a word of its own, without it too where the model knows it as one."""
        if " " not in token:
            return [self.read(token)]
        rest = [t for t, edge in ((token[2:], token[0]), (token[:-2], token[-1])) if f"^^{edge}" in self.letters and f"^{edge}$" in self.letters]
        return [self.read(token), self.read(token, BREAK_GAIN), *map(self.read, rest)]

    def read(self, token: str, gain: float = 0.0) -> str:
        bare = EDGES.sub("", token)
        if bare.isalpha() and not re.search(r"(.)\1\1", bare):
            return bare
        states, links = {"^^": (0.0, 0)}, [(0, "")]  # a link: the one before and the letter added
        last = ""
        for c in token:
            if c == " ":
                ended = [(s + gain + self.letters.get(state + "$", self.unseen), link) for state, (s, link) in states.items() if state != "^^"]
                if ended and ("^^" not in states or max(ended)[0] > states["^^"][0]):
                    links.append((max(ended)[1], " "))
                    states["^^"] = (max(ended)[0], len(links) - 1)
                continue
            if c.isalpha():
                options = [(c, 0.0)]
                if c == last:  # stretched: the letter may be one with the last
                    options.append(("", 0.1))
            else:
                options = [(x, SIGN_COST) for x in STANDS_FOR.get(c, "")]
                if c in DROPPABLE or not options:
                    options.append(("", DROP_COST))
            after: dict[str, tuple[float, int, str]] = {}
            for state, (score, link) in states.items():
                for x, cost in options:
                    if not x and state == "^^" and c.isalpha():  # a word's first letter repeats none
                        continue
                    to = state[1] + x if x else state
                    s = score - cost + (self.letters.get(state + x, self.unseen) if x else 0.0)
                    if to not in after or s > after[to][0]:
                        after[to] = (s, link, x)
            states, last = {}, c
            for state, (s, link, x) in after.items():
                if x:
                    links.append((link, x))
                    link = len(links) - 1
                states[state] = (s, link)
        link = max((s + self.letters.get(state + "$", self.unseen), link) for state, (s, link) in states.items())[1]
        text = []
        while link:
            link, x = links[link]
            text.append(x)
        return "".join(reversed(text))


def restored(texts: list[bytes], decoder: Decoder | None):
    """Word hashes, document of each word, and prefix hashes, restored words included.

    ``texts`` are lower-cased with separators turned into spaces. A reading stands next to
    the word as written.
    """
    h, first, end, counts = words.word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    a = np.frombuffer(b"\n".join(texts) + b"\n" + b" " * 8, np.uint8)
    if decoder is not None and len(h):
        sign = np.flatnonzero(SIGNS[a])
        triple = np.flatnonzero((a[:-2] == a[1:-1]) & (a[1:-1] == a[2:]) & ~words.SPACE[a[:-2]])
        odd = np.searchsorted(first, np.concatenate([sign, triple]), side="right") - 1
        raw = a.tobytes()
        more = [[] for _ in texts]
        for i in np.unique(odd):
            more[doc[i]].append(decoder(raw[first[i]:end[i]].decode("utf-8", "replace")))
        lead = np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))
        single = lead[end] - lead[first] == 1
        edge = np.diff(np.concatenate(([0], single.astype(np.int8), [0])))
        lows, highs = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spaced = highs - lows >= SPACED_LEAST
        for lo, hi in zip(lows[spaced], highs[spaced]):
            while lo < hi:  # a run may go on into the next text
                stop = min(hi, int(np.searchsorted(doc, doc[lo], side="right")))
                if stop - lo >= SPACED_LEAST:
                    run = [raw[first[i]:end[i]].decode("utf-8", "replace") for i in range(lo, stop)]
                    more[doc[lo]].append(decoder(" ".join(run)))
                lo = stop
        extra = [" ".join(w).encode("utf-8", "replace") for w in more]
        if any(extra):
            h2, f2, e2, c2 = words.word_hashes(extra)
            b = np.frombuffer(b"\n".join(extra) + b"\n" + b" " * 8, np.uint8)
            doc2 = np.repeat(np.arange(len(texts)), c2)
            return (np.concatenate([h, h2]), np.concatenate([doc, doc2]),
                    [np.concatenate([prefix(a, first, end, n), prefix(b, f2, e2, n)]) for n in PREFIXES])
    return h, doc, [prefix(a, first, end, n) for n in PREFIXES]


def prefix(a: np.ndarray, first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Hash of the first ``n`` bytes of each word, 0 where it has no more than that."""
    out = np.full(len(first), n, np.uint64)
    for k in range(n):
        out = out + words.BYTE_AT[k * 256 + a[first + k].astype(np.int64)]
    return np.where(end - first > n, words.mix(out), 0)


def prepared(batch_column) -> list[bytes]:
    return [t.translate(BREAK) for t in words.texts(batch_column, lower=True)]


def train_features(letters, unseen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(letters.value, unseen)
        for batch in words.slices(batches):
            texts, toxic = prepared(batch.column(0)), np.array(batch.column(1))
            for lo, hi in words.chunks(texts):
                h, doc, prefixes = restored(texts[lo:hi], decoder)
                value = np.concatenate([h, *prefixes])
                doc = np.tile(doc, 1 + len(prefixes))
                ok = value > 0
                value, doc = value[ok], doc[ok]
                once = np.unique(value ^ words.mix(doc.astype(np.uint64)), return_index=True)[1]
                hit = toxic[lo + doc[once]]
                key, at = np.unique(value[once], return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(np.bincount(at, hit, len(key)).astype(np.int64)),
                    pa.array(np.bincount(at, 1 - hit, len(key)).astype(np.int64))], names=["feature", "toxic", "clean"])
    return run


def marked_rows(bits):
    """The rows whose id is marked in the bitmap ``bits``, as ``d_id, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = marked(bits.value, np.array(batch.column(0)).view(np.uint64))
            yield batch.select([1, 2]).filter(pa.array(on))
    return run


def draw_words(bits):
    """Of the marked rows: the three words in a row with the least hash; near copies mostly draw the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in marked_rows(bits)(batches):
            for part in words.slices([batch]):
                drawn = []
                for t in prepared(part.column(1)):
                    h = words.word_hashes([t])[0]
                    g = words.gram_hashes(h, min(3, len(h))) if len(h) else np.zeros(1, np.uint64)
                    drawn.append(int(g.min().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(drawn, pa.int64())], names=["d_id", "text", "drawn"])
    return run


def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches):
        seen: dict[str, int] = {}
        for t in prepared(batch.column(0)):
            for w in set(t.decode("utf-8", "replace").split()):
                if w.isalpha():
                    w = f"^^{w}$"
                    for i in range(len(w) - 2):
                        seen[w[i:i + 3]] = seen.get(w[i:i + 3], 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])


def evidence(model: Model, texts: list[bytes], decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Strongest weight and log of the summed weights above 0, per text."""
    most, total = np.zeros(len(texts)), np.zeros(len(texts))
    for lo, hi in words.chunks(texts):
        h, doc, prefixes = restored(texts[lo:hi], decoder)
        if not len(model.keys):
            continue
        for value in (h, *prefixes):
            at = np.minimum(np.searchsorted(model.keys, value), len(model.keys) - 1)
            hit = np.flatnonzero(model.keys[at] == value)
            if len(hit):
                pair = np.unique(np.stack([doc[hit], at[hit]], 1), axis=0)
                w = model.weights[pair[:, 1]]
                np.maximum.at(most, lo + pair[:, 0], w)
                np.add.at(total, lo + pair[:, 0], np.maximum(w, 0))
    return most, np.log1p(total)


def sums(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        decoder = Decoder(m.letters, m.unseen)
        for batch in words.slices(batches):
            most, total = evidence(m, prepared(batch.column(batch.num_columns - 1)), decoder)
            b, w1, w2 = m.curve
            score = 1 / (1 + np.exp(-np.clip(b + w1 * most + w2 * total, -30, 30)))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(most), pa.array(total), pa.array(score)],
                                             names=batch.schema.names[:-1] + ["most", "total", "score"])
    return run


def fit_curve(seen: DataFrame, n: int, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression of ``y`` on ``most`` and ``total`` by Newton's method, lightly held to 0. Every step
    is one pass of sums over ``seen``, ``n`` rows."""
    x = [F.lit(1.0), F.col("most"), F.col("total")]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    w, held = np.zeros(3), ridge * 1e-3 * max(1, n)
    for _ in range(50):
        z = sum((float(w[i]) * x[i] for i in (1, 2)), F.lit(float(w[0])))
        rows = seen.withColumn("p", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))))
        got = rows.agg(*[F.sum(x[i] * x[j] * F.col("p") * (1 - F.col("p"))) for i, j in pairs],
                       *[F.sum(x[i] * (F.col("y") - F.col("p"))) for i in range(3)]).first()
        h = np.zeros((3, 3))
        for (i, j), v in zip(pairs, got):
            h[i, j] = h[j, i] = v
        step = np.linalg.solve(h + (held + 1e-9) * np.eye(3), np.array(got[6:], float) - held * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])


def labelled(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``text, y`` of the rows with a label. A bitmap of fixed size keeps back nearly all texts without
    one, so they aren't shuffled; the join is the same whatever the size of the tables."""
    hashed = lambda c: F.xxhash64(F.col(c).cast("string")).alias("anchor")
    bits = bitmap(ids.select(hashed("l_id")))
    thin = docs.select(hashed(doc_id), F.col(doc_id).alias("d_id"), F.col(text).alias("text")).mapInArrow(
        marked_rows(bits), f"d_id {dict(docs.dtypes)[doc_id]}, text string")
    return thin.join(ids.hint("merge"), F.col("d_id") == F.col("l_id")).select("text", "y")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fits the model on all labelled rows; each counts as one, copies too.

    Every trigram and every weight that reaches ``EVIDENCE`` is kept: the alphabets bound the trigrams, a weight takes
    16 bytes. Rows without a label of 0 or 1 don't count; of several labels of one id the highest does.
    Without rows of both labels every text gets the share of label 1 (a half without rows).
    """
    spark = docs.sparkSession
    ids = labels.filter(F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("l_id")).agg(F.max(toxic).cast("long").alias("y"))
    rows = saved(labelled(docs, ids, doc_id, text))
    n_toxic, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not n_toxic or n_toxic == n:
        share = (n_toxic + 0.5) / (n + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), {}, -10.0, (math.log(share / (1 - share)), 0.0, 0.0))
    grams = rows.select("text").mapInArrow(trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = grams.toArrow()
    grams = dict(zip(grams.column("gram").to_pylist(), grams.column("n").to_pylist()))
    before: dict[str, int] = {}
    for g, seen in grams.items():
        before[g[:2]] = before.get(g[:2], 0) + seen
    letters = {g: math.log((seen + 0.1) / (before[g[:2]] + 5)) for g, seen in grams.items()}
    unseen = math.log(0.1 / (max(before.values(), default=1) ** 0.5 + 5))
    sent = spark.sparkContext.broadcast(letters)
    n_clean = n - n_toxic
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    part = lambda seen, all_of: F.when(seen > 0, seen * F.log(seen * n / ((t + c) * all_of))).otherwise(0.0)
    gone = lambda left, all_of: F.when(left > 0, left * F.log(left * n / ((n - t - c) * all_of))).otherwise(0.0)
    table = rows.mapInArrow(train_features(sent, unseen), "feature long, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn(
        "g2", 2 * (part(t, n_toxic) + part(c, n_clean) + gone(n_toxic - t, n_toxic) + gone(n_clean - c, n_clean))).withColumn(
        "w", F.log(((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))))
    strong = table.filter((F.col("g2") >= EVIDENCE) & (F.col("w") > 0)).select("feature", "w").toArrow()
    keys = np.array(strong.column("feature"), np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], np.array(strong.column("w"), float)[order], letters, unseen)
    seen = saved(rows.select("y", "text").mapInArrow(
        sums(spark.sparkContext.broadcast(model)), "y long, most double, total double, score double").drop("score"))
    model.curve = fit_curve(seen, n)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score``: likelihood of label 1 for every row. Null and empty texts get the score of a
    text without evidence; repeated rows score alike; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        sums(sent), f"doc_id {kind}, most double, total double, score double").select(F.col("doc_id").alias(doc_id), "score")


def score_held_out(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` by a model that learns from the other folds only."""
    model = train(docs, labels.filter(crc_fold(FOLDS, doc_id) != 0), doc_id, text, toxic)
    return score(docs, model, doc_id, text).select(
        doc_id, (crc_fold(FOLDS, doc_id) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text scores below one half, columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    pair = docs.select(row, F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pair.schema["row"].dataType.simpleString()
    return pair.mapInArrow(sums(sent), f"row {kind}, most double, total double, score double").filter("score < 0.5").select("row.*")
