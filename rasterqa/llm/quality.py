"""Quality rules: plain counts per document and robust multivariate outliers.

Outliers are judged per language and source by the minimum covariance determinant: the
mean and covariance of the part of the documents that lie closest together, found by
concentration steps. Every step is a set of sums and a quantile per group, so a group is
never gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa.llm import words
from rasterqa.llm.common import saved

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

STATS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS_DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "n_lines long, n_upper long, n_distinct long")

#: Share of a group that its estimate rests on.
CORE = 0.6
STEPS = 4
#: Variances added to the transformed statistics, in the order of ``features``: differences
#: below these spreads are no ground to reject, however alike the rest of the group is.
FLOORS = (0.05 ** 2,) * 5
#: Squared distances are held against the chi-square value of this tail.
TAIL = 1e-5
#: Groups with fewer documents are judged with the other small groups of their language.
MIN_GROUP = 100


def document_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [[] for _ in range(8)]
        texts = words.texts(batch.column(batch.num_columns - 1))
        for lo, hi in words.chunks(texts):
            part = texts[lo:hi]
            h, first, end, counts = words.word_hashes(part)
            a = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
            stop = np.cumsum([len(t) + 1 for t in part])
            start = stop - np.array([len(t) + 1 for t in part])

            def inside(flags):
                total = np.concatenate(([0], np.cumsum(flags)))
                return total[stop] - total[start]

            lead = (a & 0xC0) != 0x80
            cols[0].append(counts)
            cols[1].append(inside(lead & ~words.SPACE[a]))
            cols[2].append(inside(SYMBOLS[a]))
            cols[6].append(inside((a >= 65) & (a <= 90)))
            dup, lines = [], []
            for t in part:
                full = [x for x in t.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
                lines.append(len(full))
                dup.append(len(full) - len(set(full)))
            cols[3].append(np.array(dup))
            cols[5].append(np.array(lines))
            doc = np.repeat(np.arange(len(counts)), counts)
            salt = words.mix(doc.astype(np.uint64))
            cols[7].append(np.bincount(doc[np.unique(h ^ salt, return_index=True)[1]], minlength=len(counts)))
            g = words.gram_hashes(h, 3)
            ok = np.flatnonzero(doc[:len(g)] == doc[2:]) if len(g) else np.zeros(0, np.int64)
            key = words.mix(g[ok] ^ salt[ok])
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(ok), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(h), bool)
            for k in range(3):
                covered[ok[twice] + k] = True
            cols[4].append(np.bincount(doc[covered], minlength=len(counts)))
        out = [pa.array((np.concatenate(c) if c else np.zeros(0)).astype(np.int64)) for c in cols]
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(kept + out, names=batch.schema.names[:-1] + [f.split()[0] for f in STATS_DDL.split(", ")])


def features() -> list[Column]:
    """Transformed statistics: logs and square roots bring shares and ratios near a normal shape."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return [
        F.log((F.col("word_chars") + 1) / (n + 1)),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)),
        F.sqrt(F.col("n_upper") / (F.col("word_chars") + 1)),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
    ]


def chi_square_tail(p: int, tail: float) -> float:
    """Wilson and Hilferty's approximation of the value exceeded with probability ``tail``."""
    z = NormalDist().inv_cdf(1 - tail)
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def distance(p: int) -> Column:
    """Squared Mahalanobis distance of ``x`` from ``center`` under ``inverse`` (row by row)."""
    d = [F.col("x")[i] - F.col("center")[i] for i in range(p)]
    terms = [d[i] * d[j] * F.col("inverse")[i * p + j] for i in range(p) for j in range(p)]
    return sum(terms[1:], terms[0])


def inverses(p: int, floors: tuple[float, ...]):
    """Centre and inverse covariance of each group from its sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, center, inverse = batch.column("group"), [], []
            for n, s, ss in zip(batch.column("n").to_pylist(), batch.column("s").to_pylist(), batch.column("ss").to_pylist()):
                mean = np.array(s) / n
                cov = np.array(ss).reshape(p, p) / n - np.outer(mean, mean)
                center.append(mean.tolist())
                inverse.append(np.linalg.inv((cov + cov.T) / 2 + np.diag(floors)).ravel().tolist())
            yield pa.RecordBatch.from_arrays([keys, pa.array(center, pa.list_(pa.float64())), pa.array(inverse, pa.list_(pa.float64()))],
                                             names=["group", "center", "inverse"])
    return run


def core_estimates(points: DataFrame, core: float = CORE, steps: int = STEPS, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """``group, center, inverse, scale`` of points ``group, x``: minimum covariance determinant by
    concentration steps from the coordinatewise median and spread."""
    p = len(features())
    start = points.groupBy("group").agg(
        F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(p)]).alias("center"))
    wide = points.join(start, "group").groupBy("group").agg(*[
        F.percentile_approx(F.abs(F.col("x")[i] - F.col("center")[i]), 0.5, 1000).alias(f"m{i}") for i in range(p)])
    unit = lambda i: 1 / (F.pow(F.col(f"m{i}") * 1.4826, 2) + floors[i])
    at = start.join(wide, "group").select("group", "center", F.array(*[
        unit(i) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("inverse"))
    for _ in range(steps):
        near = points.join(saved(at), "group").withColumn("d2", distance(p))
        edge = near.groupBy("group").agg(F.percentile_approx("d2", core, 1000).alias("edge"))
        inner = near.join(edge, "group").filter(F.col("d2") <= F.col("edge"))
        sums = inner.groupBy("group").agg(
            F.count("*").cast("double").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(p)]).alias("s"),
            F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(p) for j in range(p)]).alias("ss"))
        at = sums.mapInArrow(inverses(p, floors), "group string, center array<double>, inverse array<double>")
    at = saved(at)
    middle = points.join(at, "group").groupBy("group").agg(F.percentile_approx(distance(p), 0.5, 1000).alias("middle"))
    return at.join(middle, "group").withColumn("scale", F.greatest(F.col("middle") / F.lit(chi_square_tail(p, 0.5)), F.lit(1.0)))


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                  source: str = "source") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept`` and the squared distance ``d2`` behind the verdict.

    A document fails the base rules with fewer than ``MIN_WORDS`` words or more than
    ``MAX_REPEAT_PERCENT`` percent of them in repeated 3-word windows. Of the rest, those are
    rejected whose transformed statistics lie beyond the chi-square value of ``TAIL`` from
    the robust centre of their language and source. Groups under ``MIN_GROUP`` documents are
    judged together, by language; if those are still fewer, all together.

    Null and empty texts have no words and fail; null languages and sources are groups of their
    own; repeated rows are documents of their own; an empty table gives no rows; other columns
    are ignored.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    thin = docs.select(F.col(doc_id).alias("doc_id"), name(lang).alias("lang"), name(source).alias("source"), F.col(text).alias("text"))
    head = f"doc_id {dict(docs.dtypes)[doc_id]}, lang string, source string, "
    stats = thin.mapInArrow(document_stats, head + STATS_DDL)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    stats = saved(stats.withColumn("base_failed", failed).withColumn("x", F.array(*features())))

    fine = stats.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < MIN_GROUP
    pooled = fine.filter(small).groupBy(F.col("lang").alias("p_lang")).agg(F.sum("n").alias("pool"))
    group_of = fine.join(pooled, fine["lang"] == pooled.p_lang, "left").select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
        F.when(~small, F.concat_ws("\x01", "lang", "source")).when(F.col("pool") >= MIN_GROUP, F.col("lang")).otherwise("").alias("group"))
    points = saved(stats.join(group_of, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")), "left").drop("g_lang", "g_source"))
    estimates = core_estimates(points.filter(~F.col("base_failed")).select("group", "x"))
    p = len(features())
    judged = points.join(estimates, "group", "left").withColumn("d2", distance(p) / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi_square_tail(p, TAIL))
    return judged.select(F.col("doc_id").alias(doc_id), "n_words", *STATS, "base_failed", kept.alias("kept"), "d2")
