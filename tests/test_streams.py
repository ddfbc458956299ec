"""State that ends, revisions over restarts, and the diagnostics queue as a stream."""

from pyspark.sql import functions as F

from rasterqa.streaming import changes, delivery, machines
from rasterqa.streaming.runner import read_stream, run_available

TICK = "path string, tick long, etag string, modified_ms long, at long"


def drop(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def timed(spark, source):
    return read_stream(spark, source, max_files=1).withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", "1 second")


def state_rows(spark, base):
    return spark.read.format("statestore").option("stateVarName", "last").load(f"{base}/checkpoint").count()


def test_a_tick_ago_is_seen_and_earlier_is_not(spark, tmp_path):
    source = str(tmp_path / "in")
    drop(spark, source, [("a", 0, "x", 1, 0), ("a", 1, "x", 1, 1), ("b", 0, "y", 1, 0), ("b", 2, "y", 1, 2), ("c", 1, "old", 1, 1), ("c", 1, "new", 2, 1)], TICK)
    out = run_available(machines.change_stream(read_stream(spark, source), memory=1)).collect()
    assert {(r.path, r.tick, r.etag, r.is_new) for r in out} == {
        ("a", 0, "x", False), ("b", 0, "y", False), ("b", 2, "y", True), ("c", 1, "new", True)}


def test_state_goes_with_the_watermark(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "run")
    go = lambda: run_available(machines.change_stream(timed(spark, source), keep_s=100), folder=base).count()
    drop(spark, source, [(p, 0, "x", 1, 10) for p in "abcde"], TICK)
    assert go() == 5 and state_rows(spark, base) == 5
    drop(spark, source, [("a", 1, "x", 1, 90)], TICK)
    assert go() == 5 and state_rows(spark, base) == 5
    drop(spark, source, [("z", 2, "x", 1, 150)], TICK)
    assert go() == 6 and state_rows(spark, base) == 2  # a was read at 90, z at 150; b to e are over
    drop(spark, source, [("a", 3, "x", 1, 160)], TICK)
    assert go() == 6 and state_rows(spark, base) == 2


def test_limit_forgets_windows_that_are_over(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "run")
    go = lambda: {(r.key, r.call_id): r.accepted for r in run_available(
        machines.limit_stream(timed(spark, source), 2, 60), folder=base).collect()}
    call = "key long, call_id long, ts long, at long"
    drop(spark, source, [(1, 3, 30, 30), (1, 1, 10, 10), (1, 2, 20, 20), (2, 4, 10, 10)], call)
    assert go() == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 4): True}
    kept = lambda: spark.read.format("statestore").option("stateVarName", "kept").load(f"{base}/checkpoint").count()
    assert kept() == 3  # accepted times, key 1 has two
    drop(spark, source, [(3, 5, 500, 500)], call)
    go()
    assert kept() == 1


def test_a_hot_key_and_answers(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(7, i, "answer" if i == 500 else "pause", 1) for i in range(1000)]
    drop(spark, source, rows[::-1], "job_id long, at long, kind string, stage int")
    out = run_available(machines.pause_stream(read_stream(spark, source), ["at"]))
    got = {r.seq: r.paused for r in out.collect()}
    assert got == {i + 1: i < 500 for i in range(1000) if i != 500}


def test_revisions_go_on_after_a_restart(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "run")
    entry = "path string, tick long, etag string, modified_ms long"
    go = lambda: changes.publish(machines.change_stream(read_stream(spark, source)), "root", base)
    revs = lambda items: {(r.path, r.tick): (r.revision, r.is_new) for r in items.collect()}
    drop(spark, source, [("k/a", 0, "x", 1), ("k/b", 0, "y", 1), ("k/a", 1, "x", 1), ("k/a", 2, "z", 2)], entry)
    first = {("k/a", 0): (1, False), ("k/b", 0): (1, False), ("k/a", 2): (2, True)}
    assert revs(go()) == first
    drop(spark, source, [("k/a", 3, "z", 2)], entry)  # nothing changed: no revision
    assert revs(go()) == first
    drop(spark, source, [("m/sent/c", 4, "u", 3), ("m/d", 4, "v", 3)], entry)
    items = go()
    assert revs(items) == {**first, ("m/sent/c", 4): (3, True), ("m/d", 4): (3, True)}
    known = revs(items)
    assert {(r.folder, r.revision, r.n_new) for r in changes.changed_since(items, 2).collect()} == {("m", 3, 1), ("m/sent", 3, 0)}
    # The last batch runs again, as after a crash before its commit.
    import os
    commits = tmp_path / "run" / "checkpoint" / "commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (str(last), f".{last}.crc"):
        if (commits / f).exists():
            os.remove(commits / f)
    assert revs(go()) == known


def test_nothing_published_is_an_empty_table(spark, tmp_path):
    source = str(tmp_path / "in")
    drop(spark, source, [], "path string, tick long, etag string, modified_ms long")
    out = changes.publish(machines.change_stream(read_stream(spark, source)), "root", str(tmp_path / "run"))
    assert out.count() == 0 and {"path", "revision", "folder", "sent", "batch"} <= set(out.columns)


def test_polls_look_back_once(spark):
    day = 24 * 3600 * 1000
    start = 10 * day
    rows = [("old", "e", start - 2 * day), ("recent", "e", start - day + 1), ("edge", "e", start), ("next", "e", start + 1), ("later", "e", start + 8001)]
    got = {r.path: r.tick for r in changes.poll_ticks(spark.createDataFrame(rows, "path string, etag string, modified_ms long"), start, 4000).collect()}
    assert got == {"recent": 0, "edge": 0, "next": 1, "later": 3}


def test_queue_in_two_drops_with_broken_lines(spark, tmp_path):
    queue, base = tmp_path / "queue", str(tmp_path / "run")
    queue.mkdir()
    go = lambda: {(r.kind, r.message) for r in delivery.deliver(delivery.read_queue(spark, str(queue)), base).collect()}
    (queue / "1.jsonl").write_text('{"kind": "a", "message": "Authorization: Bearer abcdef123456"}\n\n{"kind": "b", "mess\n')
    assert [k for k, m in go()] == ["a"] and all("abcdef123456" not in m for _, m in go())
    (queue / "2.jsonl").write_text('{"kind": "c", "message": "fine"}\npassword=hunter2hunter2 {\n')
    assert {k for k, _ in go()} == {"a", "c"}
    aside = [r.line for r in spark.read.parquet(f"{base}/unreadable").collect()]
    assert len(aside) == 2 and any("mess" in a for a in aside) and not any("hunter2hunter2" in a for a in aside)
