import random

from pyspark.sql import functions as F

from rasterqa.functions import text as tx
from rasterqa.operators import events as ev, ordered, replies as rp, templates as tp
from rasterqa.operators.joins import as_of
from rasterqa import dims


def test_previous_row_crosses_slots(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(3), rnd.randrange(500), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, ts long, id int")
    got = {r.id: (r.prev.id if r.prev else None) for r in ordered.previous_row(df, "k", ["ts", "id"], ["id"], 50).collect()}
    for k in range(3):
        own = sorted((ts, i) for kk, ts, i in rows if kk == k)
        for (_, a), (_, b) in zip([(0, None)] + own, own):
            assert got[b] == a


def test_as_of_against_scan(spark):
    rnd = random.Random(2)
    left = [(i, rnd.randrange(4), rnd.randrange(1000)) for i in range(150)]
    right = list({(rnd.randrange(4), rnd.randrange(1000)) for _ in range(60)})
    l = spark.createDataFrame(left, "id int, k int, ts long")
    r = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k int, since long, v int")
    got = {x.id: x.v for x in as_of(l, r, "k", "ts", "since", ["v"], 100).collect()}
    for i, k, ts in left:
        best = max(((t, v) for v, (kk, t) in enumerate(right) if kk == k and t <= ts), default=(None, None))
        assert got[i] == best[1]


def test_rate_limit_does_not_store_rejected_calls(spark):
    rows = [(1, i, t) for i, t in enumerate([0, 10, 20, 61, 62, 200])]
    df = spark.createDataFrame(rows, "key long, call_id long, ts long")
    got = [r.accepted for r in ev.rate_limit(df, n=2, window=60).orderBy("call_id").collect()]
    assert got == [True, True, False, True, False, True]


def test_lockout(spark):
    rows = [(1, i, t, ok) for i, (t, ok) in enumerate([(0, False)] * 5 + [(10, True), (299, False), (300, True), (301, False)])]
    df = spark.createDataFrame(rows, "key long, attempt_id long, ts long, ok boolean")
    got = [r.outcome for r in ev.lockouts(df).orderBy("attempt_id").collect()]
    assert got == ["failure"] * 4 + ["locked", "refused", "refused", "success", "failure"]


def test_redaction(spark):
    cases = {
        "Authorization: Bearer abcdefgh123": "Authorization: ***REDACTED***",
        'password = "x y"': "password = ***REDACTED***",
        "see agt_ABCDEFGH99 now": "see ***REDACTED*** now",
        "API_KEY=zzz trailing": "API_KEY=***REDACTED***",
        "Set-Cookie: a=b; c": "Set-Cookie: ***REDACTED***",
        "nothing here": "nothing here",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.c for r in df.select("t", tx.redact(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_reply_parsers(spark):
    replies = spark.createDataFrame([
        (1, '[{"id": 1, "name": "Lion", "cells": ["A1", "B2"]}, {"id": 2, "name": "Sky", "cells": []}]'),
        (2, '```json\n[{"name": "Lion"}]\n```'), (3, "no list here"), (4, ""),
        (5, '[{"id": 1, "name": "Lion", "box": {"x": 1}}, {"id": 2, "na'),
    ], "reply_id long, text string")
    got = [(r.reply_id, r.id, r.name) for r in rp.parse_object_json(replies).filter("reply_id < 5").orderBy("reply_id", "id").collect()]
    assert got == [(1, 1, "Lion"), (1, 2, "Sky"), (2, 1, "Lion")]
    assert [r.name for r in rp.salvage_objects(replies.filter("reply_id = 5")).collect()] == ["Lion"]
    lists = spark.createDataFrame([(1, '1. **Lion**\n2) "Sky"\n- the "PRINT ON DEMAND" text\nprose\n* `code`')], "reply_id long, text string")
    assert [r.item for r in rp.parse_list(lists).orderBy("line_no").collect()] == ["Lion", "Sky", 'the "PRINT ON DEMAND" text', "code"]


def test_reply_cleaning(spark):
    cases = {
        "ChatGPT said:\nThinking\nPRO\nCopy": "PRO", '"ACT"': "ACT", "```\nACT\n```": "ACT", "`ACT`": "ACT",
        'He said "hi"': 'He said "hi"', "a\n::ref{index=\"0\"}\nb": "a\nb", "Copy\nShare": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.c for r in df.select("t", rp.clean_reply(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_templates_round_trip_and_refusal(spark):
    df = spark.createDataFrame([("a {x} and {{y}}",)], "t string")
    back = df.select(tp.to_builtin(tp.to_managed(F.col("t"))), tp.builtin_fields(F.col("t"))).first()
    assert back[0] == "a {x} and {{y}}" and back[1] == ["x"]
    lib = spark.createDataFrame([("A", "K.A", "do {x}"), ("B", "K.B", "do {x}"), ("C", "K.C", "do {x}")], "name string, key string, builtin string")
    man = spark.createDataFrame([("K.A", 1, 7, "go {{x}}"), ("K.B", 2, 8, "go {{x}} {{z}}")], "key string, version_id int, number int, text string")
    got = {r.name: (r.run_text, r.source, r.unknown) for r in tp.resolve(lib, man).collect()}
    assert got == {"A": ("go {x}", "managed", ""), "B": ("do {x}", "built_in", "z"), "C": ("do {x}", "built_in", None)}


def test_addresses(spark):
    cases = {"127.0.0.1": True, "10.1.2.3": True, "192.168.0.9": True, "169.254.169.254": True, "::1": True, "8.8.8.8": False, "example.com": None}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.b for r in df.select("h", tx.blocked_host(F.col("h")).alias("b")).collect()} == cases


def test_garment_names(spark):
    colours = dims.rows(spark, [(n, h, i) for i, (n, h) in enumerate(dims.GARMENT_COLOURS)], "name string, hex string, position int")
    names = spark.createDataFrame([("Heather Grey Marl",), ("dark navy",), ("NAVY tee",), ("plaid",)], "name string")
    known = dict(dims.GARMENT_COLOURS)
    got = {r.name: r.hex for r in rp.garment_hex(names, colours).collect()}
    assert got == {"Heather Grey Marl": known["heather grey"], "dark navy": known["navy"], "NAVY tee": known["navy"], "plaid": None}


def test_job_rules(spark):
    df = spark.createDataFrame([("x/AW-dda02-0001-SRC.jpg", "abcdef"), ("photo.png", "abcdef")], "f string, id string")
    got = [r[0] for r in df.select(ev.job_number(F.col("f"), F.lit("2024-05-06").cast("date"), F.col("id"))).collect()]
    assert got == ["AW-DDA02-0001", "JOB-20240506-ABCD"]
    v = spark.createDataFrame([("1.7.0",), ("1.10",), ("1.6.9",), ("unknown",), (None,)], "v string")
    assert [r[0] for r in v.select(ev.version_at_least(F.col("v"), "1.7.0")).collect()] == [True, True, False, False, False]
