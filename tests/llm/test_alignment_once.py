"""Each text is cut and aligned once."""

from conftest import SF
from rasterqa.llm import alignment
from rasterqa.llm.queries import tokenizer_pair


def test_texts_are_read_by_one_job(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    seen = docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")
    out = alignment.align_tokenizers(seen, *tokenizer_pair())
    assert out.filter("n_links > 0 and count_sum >= n_links").count() > 0
    assert read.value == docs.count()
