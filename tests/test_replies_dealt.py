"""Replies of a table that comes as one split are read by more than one task."""

import rasterqa.plans  # noqa: F401
from rasterqa.plans.registry import QUERIES


def test_one_file_many_tasks(spark):
    for name in ("g3_parse_objects", "g4_salvage_objects"):
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
