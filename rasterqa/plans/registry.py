"""Named queries over the given tables, each with its SQL counterpart if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterqa.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` where ``t(table)`` reads one of the given tables."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return fn(Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = exact_rounding(sql)
        return fn

    return wrap


def exact_rounding(sql: str) -> str:
    """Spell ``round_even(x, n)`` so that it rounds the exact binary value.

    The engine's own function scales first and can meet ties that are not there;
    printing to n decimals is exact.
    """
    mark = "round_even("
    at = sql.find(mark)
    if at < 0:
        return sql
    depth, comma, end = 1, -1, at + len(mark)
    while depth:
        c = sql[end]
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 1:
            comma = end
        end += 1
    value = exact_rounding(sql[at + len(mark):comma])
    digits = int(sql[comma + 1:end - 1])
    text = f"(CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE) + 0.0)"
    return sql[:at] + text + exact_rounding(sql[end:])


class Tables:
    """Reads ``<dir>/<table>.parquet`` on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
