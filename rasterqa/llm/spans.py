"""Spans of pattern matches in whole texts, by DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


BLOCK = 1024


def in_blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` code points, from which ``cut`` takes parts without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text in blocks."""
    def part(at):
        first, last = at["first"], at["last"]
        pieces = F.when(last <= first + 1, F.concat(F.coalesce(F.get(blocks, first), F.lit("")), F.when(
            last > first, F.coalesce(F.get(blocks, last), F.lit(""))).otherwise(""))).otherwise(
            F.array_join(F.slice(blocks, first + 1, last - first + 1), ""))
        return pieces.substr((start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))

    block = lambda x: F.floor(x / BLOCK).cast("int")
    return bound(F.struct(block(start).alias("first"), block(F.greatest(end - 1, start)).alias("last")), part)


def no_spans() -> Column:
    return F.array().cast(SPAN)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` reads it for every element."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, op: Callable[[Column, Column], Column], backwards: bool = False) -> Column:
    """Running sums, minima or the like of an array of longs, by doubling: element ``i`` takes the one
    ``2**k`` places before it (after it: ``backwards``) in round ``k``, n log n steps in all."""
    def step(acc, k):
        far = F.pow(F.lit(2), k).cast("int")
        there = lambda i: i + far if backwards else i - far
        inside = lambda i: there(i) < F.size(acc) if backwards else there(i) >= 0
        return F.transform(acc, lambda x, i: F.when(inside(i), op(x, F.get(acc, there(i)))).otherwise(x))

    def folded(v):
        rounds = F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int")
        return F.aggregate(F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>")), v, step)

    return bound(values, folded)


def with_matches(df: DataFrame, text: str, kind: str, pattern: str, out: str, only_if: Column | None = None) -> DataFrame:
    """Adds ``out``: the leftmost non-overlapping matches as ``struct<kind, start, end, value>``.

    Places count code points, ends are exclusive. The pieces between matches give them: a match
    ends after all pieces and matches up to its own. ``only_if`` is a cheap condition without which
    there is no match.
    """
    t = F.col(text) if only_if is None else F.when(only_if, F.col(text))
    def spans_of(m):
        found, gaps = m["found"], m["gaps"]
        ends = running(F.transform(found, lambda v, i: (F.get(gaps, i) + F.length(v)).cast("bigint")), lambda x, y: x + y)
        return bound(ends, lambda e: F.transform(found, lambda v, i: F.struct(
            F.lit(kind).alias("kind"), (F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"), v.alias("value"))))

    df = df.withColumn("_found", F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    pieces = F.transform(F.split(F.col(text), pattern, -1), F.length)
    spans = F.when(F.size("_found") > 0, bound(F.struct(F.col("_found").alias("found"), pieces.alias("gaps")), spans_of))
    return df.withColumn(out, F.coalesce(spans, no_spans())).drop("_found")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def ordered(spans: Column, kinds: tuple[str, ...], start_first: bool) -> Column:
    """Distinct spans by kind as listed and start, or by start and kind; other kinds last."""
    def keyed(s):
        rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]), F.lit(0)), F.lit(len(kinds) + 1))
        first, second = (s["start"], rank) if start_first else (rank, s["start"])
        return F.struct(first.alias("o1"), second.alias("o2"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))

    sort = F.array_sort(F.transform(spans, keyed))
    once = bound(sort, lambda a: F.filter(a, lambda s, i: (i == 0) | (s != F.get(a, i - 1))))
    return F.transform(once, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def apart_from(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, by start. Both are sorted into one array; a span is
    free if all others that start up to it end before it and the next one starts after it."""
    def marked(s, other):
        return F.struct(s["start"].alias("start"), F.lit(other).alias("other"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))

    both = F.array_sort(F.concat(F.transform(spans, lambda s: marked(s, False)), F.transform(others, lambda s: marked(s, True))))

    def free(a):
        ends = running(F.transform(a, lambda s: F.when(s["other"], s["end"]).otherwise(F.lit(0)).cast("bigint")), F.greatest)
        starts = running(F.transform(a, lambda s: F.when(s["other"], s["start"]).otherwise(F.lit(2**62)).cast("bigint")), F.least, backwards=True)
        return bound(F.struct(ends.alias("ends"), starts.alias("starts")), lambda near: F.filter(a, lambda s, i: ~s["other"] & (
            F.get(near["ends"], i) <= s["start"]) & (F.get(near["starts"], i) >= s["end"])))

    return F.transform(bound(both, free), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
