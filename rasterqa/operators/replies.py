"""Free-text replies to rows: JSON objects, lists, recommendations, boxes, grid cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterqa import dims
from rasterqa.operators.joins import first_match

OBJECT = "array<struct<id:string,name:string,type:string,cells:string>>"
ONE = "struct<id:string,name:string,type:string,cells:string>"


def json_body(text: Column) -> Column:
    """Reply without code fence, cut to its outermost ``[...]``."""
    bare = strip(text)
    fenced = strip(F.regexp_replace(F.regexp_replace(bare, r"^```[a-zA-Z0-9]*\s*", ""), r"\s*```$", ""))
    body = F.when(bare.startswith("```"), fenced).otherwise(bare)
    cut = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    return F.when(body.startswith("[") | (cut == ""), body).otherwise(cut)


def _coerced(obj: Column, pos: Column) -> list[Column]:
    cells = F.filter(F.transform(F.from_json(obj["cells"], "array<string>"), lambda c: F.trim(c)), lambda c: c != "")
    return [
        F.coalesce(obj["id"].try_cast("int"), pos).alias("id"), F.trim(obj["name"]).alias("name"),
        F.lower(F.trim(F.coalesce(obj["type"], F.lit("")))).alias("type"),
        (F.lower(F.trim(obj["cells"])) == "missing").alias("missing"), F.coalesce(cells, F.array().cast("array<string>")).alias("cells"),
    ]


def dealt(replies: DataFrame) -> DataFrame:
    """Replies spread by id over as many tasks as a shuffle has: reading them takes far longer than the few
    megabytes of a table suggest, which may come as one split."""
    return replies.repartition(int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions")), "reply_id")


def parse_object_json(replies: DataFrame) -> DataFrame:
    """Objects of well-formed replies ``(reply_id, text)``; blank names dropped."""
    whole = dealt(replies).select("reply_id", F.from_json(json_body(F.col("text")), OBJECT, {"mode": "PERMISSIVE"}).alias("objs"))
    rows = whole.select("reply_id", F.posexplode("objs").alias("i", "o"))
    return rows.select("reply_id", *_coerced(F.col("o"), F.col("i") + 1)).filter("name <> ''")


def balanced_blocks(text: Column) -> Column:
    """Outermost ``{...}`` blocks, by one fold over the text cut at its braces."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(acc, piece):
        opens, closes = piece == "{", piece == "}"
        depth = acc["depth"] + opens.cast("int")
        buf = F.when(opens & (acc["depth"] == 0), F.lit("")).otherwise(acc["buf"])
        buf = F.when(depth > 0, F.concat(buf, piece)).otherwise(buf)
        after = depth - closes.cast("int")
        done = closes & (after == 0) & (buf != "")
        return F.struct(after.alias("depth"), F.when(done, F.lit("")).otherwise(buf).alias("buf"),
                        F.when(done, F.concat(acc["out"], F.array(buf))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(text, r"(?<=[{}])|(?=[{}])", -1), start, step, lambda acc: acc["out"])


def salvage_objects(replies: DataFrame) -> DataFrame:
    """Complete ``{...}`` objects of cut-off replies, nested however deep."""
    blocks = balanced_blocks(json_body(F.col("text")))
    rows = dealt(replies).select("reply_id", F.posexplode(blocks).alias("i", "block"))
    parsed = rows.select("reply_id", "i", F.from_json("block", ONE).alias("o"))
    return parsed.select("reply_id", *_coerced(F.col("o"), F.col("i") + 1)).filter("name <> ''")


# How list items open and what is left out of a readable name; fixed patterns.
ITEM = r"^\s*(?:\d+\s*[.)\-:]|[-*•–])\s*(.+?)\s*$"


def _undecorate(item: Column) -> Column:
    """Peel matching emphasis marks, then quotes that wrap the whole item."""
    def peel(text: Column) -> Column:
        for mark in (r"\*\*", "__", r"\*", "_", "`"):
            text = F.regexp_replace(text, rf"^{mark}\s*(.+?)\s*{mark}$", "$1")
        return text

    # every round that changes something takes a leading mark, so their number bounds the rounds
    rounds = F.length(F.regexp_extract(item, r"^[*_`\s]*", 0))
    item = F.when(rounds > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), item, lambda acc, _: peel(acc))).otherwise(item)
    for left, right in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’")):
        inner = f"[^{left}]*"
        item = F.regexp_replace(item, rf"^{left}\s*({inner}?)\s*{right}$", "$1")
    return F.trim(item)


def parse_list(replies: DataFrame) -> DataFrame:
    """Items of numbered or bulleted lines, decoration off, in line order."""
    lines = replies.select("reply_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    items = lines.withColumn("item", F.regexp_extract("line", ITEM, 1)).filter("item <> ''")
    return items.select("reply_id", "line_no", _undecorate(F.col("item")).alias("item")).filter("item <> ''")


def find_colour(df: DataFrame, text: str, keys: list[str], colours: DataFrame) -> DataFrame:
    """Known colour name found earliest in the text of each row (``keys``), the longest at that spot.

    ``colours(name, hex, position)`` is a fixed list of a few dozen names: one alternation,
    longest name first, reads a text once. Rows without a name are left out.
    """
    names = sorted({r.name for r in colours.select("name").collect()}, key=lambda n: (-len(n), n))
    known = r"\b(" + "|".join(re.escape(n) for n in names) + r")\b"
    first = F.regexp_extract(F.lower(F.col(text)), known, 1)
    one = colours.groupBy(F.col("name").alias("colour")).agg(F.min(F.struct("position", "hex")).alias("c"))
    return df.withColumn("colour", first).filter("colour <> ''").join(F.broadcast(one), "colour").select(
        *df.columns, "colour", F.col("c.hex").alias("hex"))


def garment_hex(names: DataFrame, colours: DataFrame) -> DataFrame:
    """Colour name to hex: exact, exact without noise words, else best word overlap.

    Distinct names only; words meet through an equi-join on the word.
    """
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    wanted = names.select("name").distinct().withColumn("key", squeeze(F.lower(F.trim("name")))).withColumn(
        "key2", squeeze(F.regexp_replace("key", dims.GARMENT_NOISE, "")))
    known = F.broadcast(colours.select(F.col("name").alias("known"), "hex", "position"))
    exact = wanted.join(known, F.col("key") == F.col("known")).select("name", F.col("hex").alias("h1"))
    clean = wanted.join(known, F.col("key2") == F.col("known")).select("name", F.col("hex").alias("h2"))
    words = F.broadcast(colours.select(
        F.col("name").alias("known"), "hex", "position", F.split("name", " ").alias("kw")).withColumn("word", F.explode("kw")))
    tokens = wanted.withColumn("iw", F.split("key2", " ")).withColumn("word", F.explode(F.array_distinct("iw")))
    scored = tokens.join(words, "word").groupBy("name", "known", "hex", "position").agg(
        F.max(F.array_contains("kw", F.element_at("iw", -1)).cast("int")).alias("last"),
        F.count("*").alias("overlap"), F.first(F.size("kw")).alias("size"))
    best = first_match(scored, ["name"], [F.desc("last"), F.desc("overlap"), F.desc("size"), F.col("position")])
    out = wanted.select("name").join(exact, "name", "left").join(clean, "name", "left").join(
        best.select("name", F.col("hex").alias("h3")), "name", "left")
    return out.select("name", F.coalesce("h1", "h2", "h3").alias("hex"))


AVOID = r"(?i)^\s*(?:[-*•]|\d+[.)])?\s*(avoid|do not|don't|not\b|steer clear|stay away|should not)"


def parse_recommendations(replies: DataFrame, colours: DataFrame) -> DataFrame:
    """Recommended and avoided colours of each reply; once a line opens the avoid part
    it stays open. First mention of a colour per part wins."""
    lines = replies.select("reply_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = lines.withColumn("line", F.trim("raw")).filter("line <> ''")
    sofar = Window.partitionBy("reply_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    flagged = lines.withColumn("avoid", F.max(F.col("line").rlike(AVOID)).over(sofar)).withColumn(
        "body", F.regexp_replace("line", r"^\s*(?:[-*•]|\d+[.)])\s*", ""))
    found = find_colour(flagged, "body", ["reply_id", "line_no"], colours)
    first = first_match(found, ["reply_id", "avoid", "colour"], [F.col("line_no")])
    after = F.regexp_extract("body", r"[-–—:]\s*(.+)$", 1)
    reason = F.substring(F.when(after != "", F.trim(after)).otherwise(F.col("body")), 1, 300)
    return first.select("reply_id", "line_no", "avoid", F.initcap("colour").alias("name"), "hex",
                        F.when(~F.col("avoid"), reason).alias("reason"))


def parse_boxes(replies: DataFrame) -> DataFrame:
    """Boxes of JSON replies ``(reply_id, w, h, text)``, clamped; empty ones dropped."""
    parsed = replies.select("reply_id", "w", "h", F.posexplode(F.from_json(
        json_body(F.col("text")), "array<struct<n:int,x:int,y:int,w:int,h:int>>")).alias("i", "b")).filter("b.w > 0 and b.h > 0")
    x = F.greatest(F.lit(0), F.least(F.col("b.x"), F.col("w") - 1))
    y = F.greatest(F.lit(0), F.least(F.col("b.y"), F.col("h") - 1))
    boxed = parsed.select(
        "reply_id", F.coalesce("b.n", F.col("i") + 1).alias("n"), x.alias("x"), y.alias("y"),
        F.least(F.col("b.w"), F.col("w") - x).alias("bw"), F.least(F.col("b.h"), F.col("h") - y).alias("bh"))
    return boxed.filter("bw > 0 and bh > 0")


# --- Fixed values: wrapper lines trimmed from the ends of a reply ---
EDGE_LINES = [
    "Latest response", "Instant", "Thinking", "Auto", "Pro", "Copy code", "Copy", "Share", "Regenerate",
    "Read aloud", "You said:", "ChatGPT said:", "Assistant said:",
    "ChatGPT can make mistakes. Check important info.",
    "ChatGPT can make mistakes. Check important info. See Cookie Preferences.",
]
EDGE_PATTERN = r"^(Worked for \d+[smh]|Searching\b|Thinking\b|Reasoned\b|\d+:\d+$|ChatGPT can make mistakes\.)"
DIRECTIVE = r"::\w[\w-]*\s*\{[^}]*\}"


def strip(text: Column) -> Column:
    """Trim every kind of white space, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_edges(text: Column) -> Column:
    """Drop wrapper and blank lines from both ends only; the middle is untouched."""
    lines = F.split(text, "\n")
    chrome = lambda l: (F.trim(l) == "") | F.trim(l).isin(EDGE_LINES) | F.trim(l).rlike(EDGE_PATTERN)
    real = F.transform(lines, lambda l: ~chrome(l))
    first = F.array_position(real, F.lit(True))
    last = F.size(lines) - F.array_position(F.reverse(real), F.lit(True)) + 1
    return F.when(first == 0, "").otherwise(strip(F.array_join(F.slice(lines, first.cast("int"), (last - first + 1).cast("int")), "\n")))


def strip_directives(text: Column) -> Column:
    """Remove ``::name{...}`` markers and the lines they leave empty; runs of blank lines
    shrink to one."""
    marked = F.regexp_replace(text, r"(?m)^[ \t]*(?:" + DIRECTIVE + r"[ \t]*)+(?:\n|\z)", "")
    bare = F.regexp_replace(marked, DIRECTIVE, "")
    return F.when(bare == text, text).otherwise(strip(F.regexp_replace(bare, r"\n(?:[ \t]*\n){2,}", "\n\n")))


def unwrap(text: Column) -> Column:
    """Take off a fence, backticks or quotes that wrap the whole reply."""
    t = strip(text)
    fenced = strip(F.regexp_replace(F.regexp_extract(t, r"(?s)^```(.*)```$", 1), r"^[A-Za-z0-9_-]*\n", ""))
    ticked = strip(F.regexp_extract(t, r"(?s)^`([^`]*)`$", 1))
    t = F.when(t.rlike(r"(?s)^```.*```$") & (F.length(t) >= 6), fenced).when(t.rlike(r"(?s)^`[^`]+`$"), ticked).otherwise(t)
    for left, right in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’")):
        t = F.regexp_replace(t, rf"(?s)^{left}\s*([^{left}{right}]*?)\s*{right}$", "$1")
    return t


def clean_reply(text: Column) -> Column:
    return unwrap(strip_directives(strip_edges(text)))


GRID = "ABCDEFGHIJ"


def cell_boxes(cells: DataFrame) -> DataFrame:
    """Cell tokens ``(object_id, cell)`` as boxes of columns and rows, 0 to 9; what lies off the grid is cut."""
    tok = F.upper(F.regexp_replace(F.trim("cell"), " ", ""))
    col = lambda c: F.instr(F.lit(GRID), c) - 1
    part = lambda i: F.regexp_extract("tok", r"^([A-J])(\d{1,2})[-:]([A-J])(\d{1,2})$", i)
    split = cells.withColumn("tok", tok).withColumn("is_range", F.col("tok").rlike(r"^[A-J]\d{1,2}[-:][A-J]\d{1,2}$"))
    one = lambda i: F.regexp_extract("tok", r"^([A-J])(\d+)$", i)
    a = F.when(F.col("is_range"), col(part(1))).otherwise(col(one(1)))
    b = F.when(F.col("is_range"), col(part(3))).otherwise(col(one(1)))
    r0 = F.when(F.col("is_range"), part(2)).otherwise(one(2)).try_cast("int")
    r1 = F.when(F.col("is_range"), part(4)).otherwise(one(2)).try_cast("int")
    known = split.filter(F.col("is_range") | (one(1) != "")).select("object_id", a.alias("a"), b.alias("b"), r0.alias("f"), r1.alias("t"))
    return known.filter("f is not null").select(
        "object_id", F.least("a", "b").alias("c0"), F.greatest("a", "b").alias("c1"),
        (F.greatest(F.least("f", "t"), F.lit(1)) - 1).alias("r0"), (F.least(F.greatest("f", "t"), F.lit(10)) - 1).alias("r1"),
    ).filter("r0 <= r1")


def cells_to_bbox(cells: DataFrame, max_fraction: float = 0.5, max_span: int = 7) -> DataFrame:
    """Normalised box of each object's cells; hints over half the grid or scattered over
    more than ``max_span`` columns or rows are rejected (NULL box).

    An object's cells are 100 bits in two words, ten a column, so a task holds two words per object.
    """
    rows = F.expr("shiftleft(shiftleft(1L, r1 - r0 + 1) - 1, r0)")
    half = lambda at: rows * sum((F.when(F.lit(c).between(F.col("c0"), F.col("c1")), F.lit(1 << (10 * (c - at)))).otherwise(F.lit(0)) for c in range(at, at + 5)), F.lit(0).cast("bigint"))
    bits = cell_boxes(cells).select("object_id", half(0).alias("left"), half(5).alias("right")).groupBy("object_id").agg(
        F.bit_or("left").alias("left"), F.bit_or("right").alias("right"))
    columns = bits.select("object_id", (F.bit_count("left") + F.bit_count("right")).cast("bigint").alias("n"), F.array(*[
        F.shiftright("left" if c < 5 else "right", 10 * (c % 5)).bitwiseAND(1023) for c in range(10)]).alias("m"))
    column = lambda c: F.col("m")[c] != 0
    row = lambda r: F.col("rows").bitwiseAND(1 << r) != 0
    least = lambda on: F.coalesce(*[F.when(on(i), i) for i in range(10)])
    most = lambda on: F.coalesce(*[F.when(on(i), i) for i in range(9, -1, -1)])
    seen = columns.withColumn("rows", F.aggregate("m", F.lit(0).cast("bigint"), lambda acc, v: acc.bitwiseOR(v)))
    agg = seen.select("object_id", "n", least(column).alias("c0"), most(column).alias("c1"), least(row).alias("r0"), most(row).alias("r1"))
    wide, tall = F.col("c1") - F.col("c0") + 1, F.col("r1") - F.col("r0") + 1
    ok = (F.col("n") <= max_fraction * 100) & (wide <= max_span) & (tall <= max_span)
    return agg.select(
        "object_id", "n", *[F.when(ok, (v / 10)).alias(a) for a, v in (
            ("x", F.col("c0")), ("y", F.col("r0")), ("w", wide), ("h", tall))],
        (wide * tall / 100 >= 0.6).alias("large"))


def pair_status(objects: DataFrame) -> DataFrame:
    """Where each listed object stands: skipped, missing, added, absent, unlocatable, paired.

    ``objects(pair_id, id, type, n1, n2, x1, x2)``: cell counts (NULL = missing) and box
    positions (NULL = no usable box) in the two images.
    """
    in1, in2 = F.coalesce(F.col("n1"), F.lit(0)) > 0, F.coalesce(F.col("n2"), F.lit(0)) > 0
    status = (
        F.when(F.col("type") == "background", "skipped").when(in1 & ~in2, "missing").when(in2 & ~in1, "added")
        .when(~in1 & ~in2, "absent").when(F.col("x1").isNull() | F.col("x2").isNull(), "unlocatable").otherwise("paired"))
    return objects.withColumn("status", status)
