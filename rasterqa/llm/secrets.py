"""Secrets, and who owns them: widely copied examples apart from live-looking credentials.

A candidate's hash is counted over the whole corpus by distinct repositories and owners. What
many owners hold is an example that was copied about; what few hold is taken as live.
Everything is a DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa.llm.common import saved, whole_text
from rasterqa.llm.spans import apart_from, bound, cut, in_blocks, no_spans, ordered, running, with_matches

KINDS = ("assign", "access", "hex")

# The kinds' patterns, with possessive runs: the same matches in linear time.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]++"
LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}+"

ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Distinct characters that a long word of mixed cases and digits must have to be a candidate.
LONG_DISTINCT = 16
#: Owners from which on a secret counts as a copied example.
EXAMPLE_OWNERS = 8
MASK = "[SECRET]"


def secret_of(span: Column) -> Column:
    """The secret itself: the assigned value, or the whole match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], VALUE, 1)).otherwise(span["value"])


def with_candidates(df: DataFrame, text: str, base: str, other: str) -> DataFrame:
    """Adds the spans of the plain kinds, by start and kind, and of further long mixed words."""
    t = F.col(text)
    sign = F.rlike(t, F.lit("[:=]"))
    df = with_matches(df, text, "assign", ASSIGN, "_assign", sign)
    df = with_matches(df, text, "access", ACCESS, "_access", F.contains(t, F.lit("AKIA")))
    df = with_matches(df, text, "hex", HEX + "(?<=[0-9a-f]{24})", "_hex", F.rlike(t, F.lit("[0-9a-f]{24}")))
    df = with_matches(df, text, "other", LONG, "_long", F.rlike(t, F.lit("[A-Za-z0-9+/_-]{32}")))
    assign = F.filter("_assign", lambda s: F.length(F.regexp_extract(s["value"], VALUE, 1)) >= ASSIGN_LEAST)
    access = F.filter("_access", lambda s: F.length(s["value"]) >= ACCESS_LEAST)
    hexes = F.filter("_hex", lambda s: F.length(s["value"]) >= HEX_LEAST)
    df = df.withColumn(base, ordered(F.concat(assign, access, hexes), KINDS, start_first=True))

    def mixed(s):
        v = s["value"]
        signs = F.size(F.array_distinct(F.split(v, "(?!^)(?!$)")))
        return F.rlike(v, F.lit("[a-z]")) & F.rlike(v, F.lit("[A-Z]")) & F.rlike(v, F.lit("[0-9]")) & (signs >= LONG_DISTINCT)

    more = apart_from(F.filter("_long", mixed), F.col(base))
    return df.withColumn(other, F.when(F.size("_long") > 0, more).otherwise(no_spans())).drop("_assign", "_access", "_hex", "_long")


def ownership(uses: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``secret, repositories, owners, example`` of uses ``secret, repository, owner``.

    Distinct uses are counted level by level, so a secret that a third of all rows hold is
    summed in part everywhere before it meets.
    """
    by_owner = uses.groupBy("secret", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("secret", "owner").agg(F.sum("one").alias("n"))
    return by_owner.groupBy("secret").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners")).withColumn(
        "example", F.col("owners") >= example_owners)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source",
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``doc_id, key, base, spans, live, examples``: plain spans, all spans, and the two classes of spans.

    Spans are ``struct<kind, start, end, value>`` in code points, end exclusive, by start and kind; ``key`` is
    a hash of the text. Null and empty texts have no spans; null owners and repositories count as
    one of their own; long texts are read whole; repeated rows get the same spans each and
    count as one repository; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("text"), F.col(repository).alias("repository"), F.col(owner).alias("owner"))
    rows = with_candidates(rows, "text", "base", "other").withColumn("key", F.xxhash64("text"))
    rows = rows.withColumn("spans", F.when(F.size("other") > 0, ordered(F.concat("base", "other"), KINDS, start_first=True)).otherwise(F.col("base")))
    rows = saved(rows.select("id", "key", "repository", "owner", "base", "spans"))
    each = rows.filter(F.size("spans") > 0).select("id", "key", "repository", "owner", F.explode("spans").alias("s"))
    each = each.withColumn("secret", F.sha2(secret_of(F.col("s")), 256))
    freq = ownership(each.select("secret", "repository", "owner"), example_owners).select("secret", "example")
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    judged = each.select(text_id.alias("t_id"), F.col("key").alias("t_key"), "s", "secret").distinct().join(freq, "secret")
    by_doc = judged.groupBy("t_id", "t_key").agg(F.collect_list(F.when(~F.col("example"), F.col("s"))).alias("live"),
                                                F.collect_list(F.when(F.col("example"), F.col("s"))).alias("examples"))
    out = rows.join(by_doc, (text_id == F.col("t_id")) & (F.col("key") == F.col("t_key")), "left")
    none = no_spans()
    return out.select(F.col("id").alias(doc_id), "key", "base", "spans", F.coalesce(F.array_sort("live"), none).alias("live"),
                      F.coalesce(F.array_sort("examples"), none).alias("examples"))


def masked(text: Column, spans: Column) -> Column:
    """The text with the spans replaced by a mask; spans that overlap become one."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def pieces(both):
        blocks, around, upto = both["blocks"], both["spans"], both["upto"]  # upto: the furthest end so far

        def piece(s, i):
            at = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(upto, i - 1))
            return F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"]), F.lit(MASK))).otherwise("")

        rest = cut(blocks, F.get(upto, F.size(upto) - 1), F.length(text).cast("bigint"))
        return F.concat(F.array_join(F.transform(around, piece), ""), rest)

    return bound(by_start, lambda a: bound(F.struct(
        in_blocks(text).alias("blocks"), a.alias("spans"), running(F.transform(a, lambda s: s["end"]), F.greatest).alias("upto")), pieces))


def mask_live_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", **settings) -> DataFrame:
    """All rows with their columns, live-looking secrets masked in the text; a length column follows.

    Rows without any sign of a secret aren't shuffled.
    """
    key = F.xxhash64(whole_text(text))
    found = find_secrets(docs, doc_id, text, **settings).filter(F.size("live") > 0).select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("s_id"), F.col("key").alias("s_key"), "live").dropDuplicates(["s_id", "s_key"])
    whole = whole_text(text)
    sign = F.rlike(whole, F.lit(rf"(?:{ASSIGN})|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|[A-Za-z0-9+/_-]{{32}}"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    may = docs.filter(sign).select(row, F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("r_id"), key.alias("r_key"))
    hit = may.join(found, (F.col("r_id") == F.col("s_id")) & (F.col("r_key") == F.col("s_key")), "left")
    old = F.col("row").getField(text)
    new = F.when(F.size("live") > 0, masked(old, F.col("live"))).otherwise(old)
    hit = hit.select("row", new.alias("new"))
    changed = F.col("row").withField(f"`{text}`", F.col("new"))
    if length in docs.columns:
        changed = F.when(F.col("new") == old, F.col("row")).otherwise(changed.withField(
            f"`{length}`", F.length("new").cast(docs.schema[length].dataType)))
    return docs.filter(~sign).unionByName(hit.select(changed.alias("row")).select("row.*"))
