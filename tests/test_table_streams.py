"""Streams over tables that are one file or a folder of files."""

import rasterqa.plans  # noqa: F401
from rasterqa.plans.registry import QUERIES
from rasterqa.streaming.runner import read_table_stream, run_available

SF = "/root/testdata/sf0.001"


def test_tables_that_are_folders(spark, tmp_path):
    for name, parts in (("pages", 3), ("documents", 2)):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = lambda name, sf: sorted(map(tuple, QUERIES[name](spark, sf).collect()))
    for name in ("st1_change_feed", "st2_revisions_stream", "st8_diag_delivery"):
        assert rows(name, str(tmp_path)) == rows(name, SF) != []


def test_files_come_in_turn(spark, tmp_path):
    spark.range(10).repartition(5).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/t.parquet.old")
    assert run_available(read_table_stream(spark, str(tmp_path), "t", max_files=1)).count() == 10
