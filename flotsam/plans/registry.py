"""Queries with the columns that they return, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def shaped(df: DataFrame, columns: str, digits: int = 6) -> DataFrame:
    """The named columns ("name:i name:d name:s name:b name:t"), whole numbers as long, others rounded."""
    out = []
    for name, kind in (c.split(":") for c in columns.split()):
        c = F.col(name)
        out.append({"i": c.cast("long"), "d": F.round(c.cast("double"), digits) + F.lit(0.0), "s": c.cast("string"), "b": c.cast("boolean"), "t": c}[kind].alias(name))
    return df.select(*out)


def shaped_sql(inner: str, columns: str, digits: int = 6, ctes: str = "") -> str:
    kinds = {"i": 'CAST("{0}" AS BIGINT)', "d": f'round(CAST("{{0}}" AS DOUBLE), {digits}) + 0.0', "s": 'CAST("{0}" AS VARCHAR)', "b": 'CAST("{0}" AS BOOLEAN)', "t": '"{0}"'}
    cols = ", ".join(f'{kinds[k].format(n)} AS "{n}"' for n, k in (c.split(":") for c in columns.split()))
    return f"{'WITH ' + ctes if ctes else ''} SELECT {cols} FROM ({inner})"


def register(name: str, columns: str, sql: str | None = None, ctes: str = "", digits: int = 6):
    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(spark, sf_dir), columns, digits)
        if sql:
            SQL[name] = shaped_sql(sql, columns, digits, ctes)
        return fn

    return put
