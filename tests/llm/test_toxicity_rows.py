"""The model learns from every labelled row."""

import inspect

from rasterqa.llm import toxicity


def test_more_rows_than_the_old_sample(spark):
    # the word shows in a few of 24,000 labelled rows; a sample of 20,000 by hash held some of them only
    docs = spark.range(24_000).selectExpr(
        "id as doc_id", "concat('note ', id, ' about item ', id * 7, if(id % 300 = 0, ' grumblesnark', ' meadow')) as text",
        "cast(id % 300 = 0 as int) as toxic").localCheckpoint()
    table = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    share = toxicity.score(docs.select("doc_id", "text").filter("doc_id % 300 = 0"), table)
    assert share.filter("score >= 0.5").count() == 80
    seen = toxicity.score(docs.select("doc_id", "text").filter("doc_id % 300 = 1"), table)
    assert seen.filter("score < 0.5").count() == 80
    assert "sample_rows" not in inspect.signature(toxicity.train).parameters
