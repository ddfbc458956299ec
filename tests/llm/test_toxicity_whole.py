"""Rows that share a line with others are learned from like any row."""

from rasterqa.llm import toxicity

LINE = "all rights reserved by the owner of this page and no part of it may be copied"


def test_rows_with_a_common_line_all_count(spark):
    # one label's rows all draw the same three words of the line; the word shows in one of two of them
    rows = spark.range(400).selectExpr(
        "id as doc_id", f"concat(if(id % 4 = 0, 'grumblesnark ', if(id % 4 = 2, 'sneerbucket ', 'meadow ')), '{LINE}') as text",
        "cast(id % 2 = 0 as int) as toxic").localCheckpoint()
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    out = toxicity.score(rows.select("doc_id", "text"), model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in out)
    assert len(model.keys) == 6  # two words, two beginnings of each


def test_no_weight_and_no_trigram_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 5, raising=False)
    many = [f"xq{a}{b}zword" for a in "abcdefghij" for b in "abcdefghij"]
    bad = " ".join(many)
    rows = spark.range(200).selectExpr(
        "id as doc_id", f"concat('note ', id, ' on item ', id * 7, if(id % 2 = 0, ' {bad}', ' meadow')) as text",
        "cast(id % 2 = 0 as int) as toxic").localCheckpoint()
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert len(model.keys) == 300  # the words, their first four and their first five bytes
    assert all(f"q{a}{b}" in model.letters for a in "abcdefghij" for b in "abcdefghij")
