"""Pauses over restarts: numbers and answers go on, and state ends with the watermark."""

import time

from pyspark.sql import functions as F

from rasterqa.streaming.machines import pause_stream
from rasterqa.streaming.runner import read_stream, run_available

STEP = "job_id long, at long, kind string, stage int, event_s long"


def test_answers_last_over_restarts_and_end(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "run")

    def drop(*rows):
        spark.createDataFrame(rows, STEP).coalesce(1).write.mode("append").parquet(source)
        steps = read_stream(spark, source, max_files=1).withColumn("event_time", F.timestamp_seconds("event_s")).withWatermark("event_time", "1 second")
        out = run_available(pause_stream(steps, ["at"], keep_s=100), folder=base)
        return {(r.job_id, r.seq, r.stage, r.paused) for r in out.collect()}

    one = drop((1, 3, "pause", 2, 10), (1, 2, "answer", 2, 10), (1, 1, "pause", 2, 10), (2, None, "pause", 1, 10), (2, 5, "answer", 1, 10))
    assert one == {(1, 1, 2, True), (1, 3, 2, False), (2, 2, 1, False)}
    two = drop((1, 4, "pause", 2, 60), (1, 5, "pause", 0, 60)) - one
    assert two == {(1, 4, 2, False), (1, 5, 0, True)}
    drop((9, 1, "run", 0, 300))
    three = drop((1, 6, "pause", 2, 310))
    assert (1, 1, 2, True) in three and len(three) == 5  # job 1 was over: it starts at one again


def test_rows_without_a_job(spark, tmp_path):
    source, big = str(tmp_path / "in"), (1 << 60) + 1
    rows = [(None, 1, "answer", 1), (None, 2, "pause", 1), (None, 3, "pause", 2), (big, 1, "pause", 1)]
    spark.createDataFrame(rows, "job_id long, at long, kind string, stage int").coalesce(1).write.parquet(source)
    out = run_available(pause_stream(read_stream(spark, source), ["at"]))
    assert {tuple(r) for r in out.collect()} == {(None, 2, 1, False), (None, 3, 2, True), (big, 1, 1, True)}


def test_many_short_jobs(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(120_000).selectExpr("id % 60000 as job_id", "id as at", "if(id < 60000, 'answer', 'pause') as kind", "cast(job_id % 3 as int) as stage").write.parquet(source)
    began = time.time()
    out = run_available(pause_stream(read_stream(spark, source), ["at"]))
    assert out.filter("not paused and seq = 2").count() == 60_000
    assert time.time() - began < 30  # a call for each job took 5 ms, 300 s over all threads
