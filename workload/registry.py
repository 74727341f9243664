"""Name -> (Spark query, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Project and round every double, so both engines print the same digits."""
    types = dict(df.dtypes)
    picked = columns or df.columns
    return df.select(
        *[
            (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)
            if types[c] == "double"
            else F.col(c).cast("long").alias(c)
            if types[c] == "int"
            else F.col(c)
            for c in picked
        ]
    )


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """SQL twin of ``shown`` for one column."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {name or expression}"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(r(n.strip(), digits=digits) for n in names.split(","))
