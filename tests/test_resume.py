"""Streams that stop and start again over two drops of files."""

from rasterqa.streaming import delivery, machines
from rasterqa.streaming.runner import read_stream, run_available

ENTRY = "path string, tick long, etag string, modified_ms long"


def test_changes_go_on_where_they_stopped(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "run")
    drop = lambda rows: spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(source)
    go = lambda: {(r.path, r.tick) for r in run_available(machines.change_stream(read_stream(spark, source)), folder=base).collect()}
    drop([("a", 0, "x", 1), ("b", 0, "y", 1), ("a", 1, "x", 2)])
    assert go() == {("a", 0), ("b", 0)}
    drop([("a", 2, "z", 3), ("b", 2, "y", 3), ("b", 0, "late", 3)])
    assert go() == {("a", 0), ("b", 0), ("a", 2)}
    assert go() == {("a", 0), ("b", 0), ("a", 2)}


def test_delivery_goes_on_where_it_stopped(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "run")
    drop = lambda i: spark.createDataFrame([(i, "Authorization: Bearer abcdef123456", {"password": "p", "ok": "1"})],
                                           "n int, message string, detail map<string,string>").write.mode("append").parquet(source)
    go = lambda: delivery.deliver(read_stream(spark, source, max_files=1), base).collect()
    drop(1)
    assert [r.n for r in go()] == [1]
    drop(2)
    rows = go()
    assert sorted(r.n for r in rows) == [1, 2] and len({r.batch for r in rows}) == 2
    assert all("abcdef123456" not in r.message and r.detail == {"ok": "1"} for r in rows)
