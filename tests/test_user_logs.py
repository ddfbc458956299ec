"""The user log summary is what its SQL gives, on odd rows too."""

import duckdb

import __spark_entry__ as entry
from rasterqa.plans.registry import QUERIES

ROWS = [
    (1, "a b", "en", "src0"), (2, "", "en", "src0"), (3, None, "en", "src0"), (None, "x", "en", "src0"), (4, "", "de", "src0"),
    (5, None, "fr", "src0"), (6, "x", None, "src1"), (7, "yy", "en", None), (8, "z", "", ""), (9, "\U0001f600 é\n", "zh", "größe"),
    (10, "u", "en", "日本"), (11, "u", "en", "s" * 130), (12, "v", "en", "s" * 131), (13, "w", "en", "\U0001f600.x@y-z"),
]


def test_odd_rows_as_the_sql_has_them(spark, tmp_path):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["s11_user_logs"]).fetchall()
    got = [tuple(r) for r in QUERIES["s11_user_logs"](spark, str(tmp_path)).select("user_key", "lines", "chars").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
