"""The operators over the whole given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterqa.llm import alignment, lm, mixing, neardup, packing, pages, pii, quality, runs, secrets, substrings, topk, toxicity
from rasterqa.llm.common import crc_fold, documents, whole_text
from rasterqa.llm.spans import count_kind, joined

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3.0::DOUBLE AS cap,
    [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(lev) FROM l WHERE lev * weight <= cap) * weight, cap)) AS target,
    CAST('0x' || substr(md5('mix:' || coalesce('=' || source, '-')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM l),
p AS (SELECT d.*, source_size, target, u, target / source_size AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size = 0, CAST(floor(ln(greatest(size, 1)) / ln(1.1::DOUBLE)) AS INTEGER), h % 64, size, h, doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT p.*, k, CASE WHEN size > 0 THEN least(
      floor(place * rate + (u + k / 32.0::DOUBLE - floor(u + k / 32.0::DOUBLE)))
      - floor((place - 1) * rate + (u + k / 32.0::DOUBLE - floor(u + k / 32.0::DOUBLE))), 3) ELSE 0 END AS copies
  FROM p, range(32) r(k)),
b AS (SELECT source, arg_min(k, abs(words - target) * 1000 + k / 1000000.0) AS k FROM (
    SELECT source, k, any_value(target) AS target, sum(size * copies) AS words FROM c GROUP BY source, k) GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * c.copies AS BIGINT) AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.k = b.k
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_lm_scores")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_held_out(documents(spark, sf_dir), crc_fold(10))
    return scored.withColumn("held_out", crc_fold(10) == 0)


@query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op3_mix_sources", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), keep=["doc_id"])
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_pack_windows")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


@query("op5_quality_outliers")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(documents(spark, sf_dir))


@query("op6_repeated_substrings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op8_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=3, percent=85)


@query("op9_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in secrets.KINDS],
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.size("live").cast("long").alias("n_live"), F.size("examples").cast("long").alias("n_example"))


@query("op10_top_inner_products")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """Documents whose ids' crc32 is divisible by 10 repeat a few of their words to the end,
    with a start and a period that follow from it. A null id counts as empty text."""
    h = crc_fold(1 << 32)
    words = F.filter(F.split(whole_text(), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    docs = docs.select("doc_id", "text", (h % 10).alias("fold"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    docs = docs.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    docs = docs.withColumn("p", F.when(n > 0, (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return docs.select("doc_id", F.when((F.col("fold") == 0) & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_repeats(documents(spark, sf_dir)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    longest = F.sort_array(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p")))).getItem(0)
    out = found.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, longest).alias("top"))
    length, period = -F.col("top.l"), F.col("top.p")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def tokenizer_pair() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op11_align_tokenizers")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_tokenizers(documents(spark, sf_dir), *tokenizer_pair())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256"))


@query("op12_main_text")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
