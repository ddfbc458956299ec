"""Personal data: four plain kinds, and bootstrapped contextual extraction of further ones.

Seeds are the entities that the plain patterns find. Their contexts are the lexical patterns: the word
before, the two words before, the word after, and the words before and after together. Patterns and
instances form a graph that is scored in rounds: a pattern is as good as the share of its known
instances that are of its kind, unknown ones counting a little against it; an instance is as good as
the patterns that found it. What good patterns find is known in the next round.
Everything is a DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterqa.llm.common import WORD, saved, whole_text
from rasterqa.llm.spans import apart_from, bound, cut, in_blocks, no_spans, ordered, with_matches

KINDS = ("email", "ip", "card", "phone")

# The kinds' patterns. Runs are possessive and start where a run or the last match ends:
# the same matches, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Identifier-like words: letters, digits and signs, with a digit, an underscore or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[A-Za-z.%+()-]*+[0-9_@][A-Za-z0-9._%+@()-]*+(?![^\x20\x09-\x0D,;:!?])"
CANDIDATE_SIGN = "[0-9_@]"
CANDIDATE_LEAST = 6
#: Characters around a span in which its neighbouring words are read; of longer words the near end counts.
CONTEXT = 64
ROUNDS = 3
#: Different seeds that a pattern must have met, and the scores that count.
PATTERN_SEEDS = 5
PATTERN_SCORE = 0.8
#: Share of a known instance of another kind that an unknown instance counts against a pattern.
UNKNOWN = 0.2
INSTANCE_SCORE = 0.8


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    d = F.transform(F.split(F.reverse(number), "(?!^)(?!$)"), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_ip(value: Column) -> Column:
    """Parts of at most 255, however many zeros lead them."""
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))


def with_base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Spans of the four plain kinds, by kind and start; failing matches are dropped, without retries."""
    digit = F.rlike(F.col(text), F.lit("[0-9]"))
    df = with_matches(df, text, "email", EMAIL, "_email", F.contains(F.col(text), F.lit("@")))
    df = with_matches(df, text, "ip", IP, "_ip", digit)
    df = with_matches(df, text, "card", CARD, "_card", digit)
    df = with_matches(df, text, "phone", PHONE, "_phone", F.contains(F.col(text), F.lit("+")))
    ip = F.filter("_ip", lambda s: is_ip(s["value"]))
    card = F.filter(F.filter("_card", lambda s: F.length(digits(s["value"])).between(13, 19)), lambda s: luhn(digits(s["value"])))
    phone = F.filter("_phone", lambda s: F.length(digits(s["value"])).between(9, 15))
    return df.withColumn(out, F.concat("_email", ip, card, phone)).drop("_email", "_ip", "_card", "_phone")


def contexts(blocks: Column, span: Column) -> Column:
    """The lexical patterns around a span, lower-cased; those whose words are missing are left out."""
    before = cut(blocks, F.greatest(span["start"] - CONTEXT, F.lit(0)), span["start"])
    after = cut(blocks, span["end"], span["end"] + CONTEXT)
    read = F.struct(F.reverse(F.regexp_extract_all(F.lower(before), F.lit(WORD), F.lit(0))).alias("left"), F.nullif(
        F.lower(F.regexp_extract(after, r"^[^A-Za-z0-9\x80-\x{10FFFF}]*+([^\x20\x09-\x0D]+)", 1)), F.lit("")).alias("right"))

    def patterns(near):  # concat gives null where a word is missing
        left, left2, right = F.get(near["left"], 0), F.get(near["left"], 1), near["right"]
        return F.array_compact(F.array(
            F.concat(F.lit("before\x01"), left), F.concat(F.lit("two before\x01"), left2, F.lit("\x01"), left),
            F.concat(F.lit("after\x01"), right), F.concat(F.lit("around\x01"), left, F.lit("\x01"), right)))

    return bound(read, patterns)


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, pattern_seeds: int = PATTERN_SEEDS,
              pattern_score: float = PATTERN_SCORE, instance_score: float = INSTANCE_SCORE, unknown: float = UNKNOWN) -> DataFrame:
    """``kind, value, score`` of the instances that good patterns discover.

    ``edges`` are pairs ``kind, value, pattern``, with kind null for candidates. An edge counts once
    however often it occurs, so copies don't vouch for a pattern, and every sum is taken in part
    before it is sent. An instance that several kinds claim goes to the best, ties to the first by name.
    """
    edges = saved(edges.distinct())
    seeds = edges.filter(F.col("kind").isNotNull()).select("kind", "value").distinct().withColumn("score", F.lit(1.0))
    seen = edges.select("value", "pattern").distinct()
    fresh = edges.filter(F.col("kind").isNull()).select("value", "pattern").join(seeds.select("value"), "value", "left_anti")
    sizes = seen.groupBy("pattern").agg(F.count("*").alias("size")).filter(F.col("size") >= pattern_seeds)
    found = None
    for _ in range(rounds):
        known = seeds if found is None else seeds.unionByName(found)
        met = seen.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.sum("score").alias("good"))
        all_kinds = met.groupBy("pattern").agg(F.sum("seeds").alias("known"), F.sum("good").alias("any")).join(sizes, "pattern")
        against = F.col("any") + unknown * F.greatest(F.col("size") - F.col("known"), F.lit(0))
        good = met.filter(F.col("seeds") >= pattern_seeds).join(all_kinds, "pattern").withColumn(
            "p", F.col("good") / against).filter(F.col("p") >= pattern_score)
        claims = fresh.join(good, "pattern").groupBy("value", "kind").agg(  # noisy or of the patterns
            (1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999)))))).alias("score"))
        best = claims.groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("b"))
        found = saved(best.select(F.col("b.kind").alias("kind"), "value", (-F.col("b.s")).alias("score")).filter(F.col("score") >= instance_score))
    return found


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans``: spans of the plain kinds, and those together with the discovered ones.

    Spans are ``struct<kind, start, end, value>`` in code points, end exclusive, by kind and start. A discovered
    span takes the kind of the seeds whose contexts it shares and never overlaps a plain one.

    Null and empty texts have no spans; long texts are read whole; repeated rows get the same spans
    each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("text"))
    rows = with_base_spans(rows, "text", "base")
    rows = with_matches(rows, "text", "?", CANDIDATE, "odd", F.rlike("text", F.lit(CANDIDATE_SIGN)))
    free = apart_from(F.filter("odd", lambda c: F.length(c["value"]) >= CANDIDATE_LEAST), F.col("base"))
    rows = rows.withColumn("odd", F.when(F.size("odd") > 0, free).otherwise(no_spans()))
    near = bound(in_blocks(F.col("text")), lambda blocks: F.transform(F.concat("base", "odd"), lambda s: F.struct(
        s["kind"].alias("kind"), s["value"].alias("value"), contexts(blocks, s).alias("patterns"))))
    key = F.when(F.size("odd") > 0, F.xxhash64("text"))
    rows = saved(rows.select("id", "base", "odd", key.alias("key"), F.when(F.size("base") + F.size("odd") > 0, near).otherwise(F.array()).alias("near")))

    edges = rows.select(F.explode("near").alias("e")).select(
        F.expr("nullif(e.kind, '?')").alias("kind"), "e.value", F.explode("e.patterns").alias("pattern"))
    found = bootstrap(edges)
    odd = rows.filter(F.size("odd") > 0).select("id", "key", F.explode("odd").alias("s")).distinct()
    more = odd.join(found.withColumnRenamed("kind", "k"), F.col("s.value") == F.col("value")).groupBy(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("m_id"), F.col("key").alias("m_key")).agg(F.collect_list(F.struct(
            F.col("k").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))).alias("more"))
    out = rows.join(more, (F.coalesce(F.col("id").cast("string"), F.lit("")) == F.col("m_id")) & (F.col("key") == F.col("m_key")), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(ordered(F.concat("base", "more"), KINDS, start_first=False))
    return out.select(F.col("id").alias(doc_id), "base", spans.alias("spans"))
