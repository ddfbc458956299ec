"""Texts without a label stay where they are while the model learns."""

from pyspark.sql import functions as F

from rasterqa.llm import toxicity


def test_only_labelled_texts_are_joined(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('note ', id, ' on item ', id * 7) as text")
    ids = spark.range(0, 20_000, 10).select(F.col("id").cast("int").alias("l_id"), F.lit(1).cast("long").alias("y"))
    out = toxicity.labelled(docs, ids, "doc_id", "text")
    assert sorted(r.text for r in out.collect()) == sorted(f"note {i} on item {i * 7}" for i in range(0, 20_000, 10))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan  # also where one side is small
    bits = toxicity.bitmap(ids.select(F.xxhash64(F.col("l_id").cast("string")).alias("anchor")))
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text").mapInArrow(
        toxicity.draw_words(bits), "d_id long, text string, drawn long")
    assert 2_000 <= rows.count() < 2_100
