"""Parsing of symbol lists and weight pairs held in text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.sources.bars import symbol


def symbol_list(text: Column) -> Column:
    """Distinct symbols in order from comma, semicolon, tab or newline separated text."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;\t\n\r]+"), lambda s: symbol(s))
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


def weight_pairs(df: DataFrame, text: str) -> DataFrame:
    """One row per entry: ``ticker``, ``weight`` and ``error`` for malformed ones."""
    entries = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"[\n,;]+"), lambda s: F.trim(s)), lambda s: s != "")
    rows = df.withColumn("entry", F.explode(entries))
    name = F.upper(F.regexp_extract("entry", r"^([^\s=]+)\s*(?:=|\s)\s*(\S+)$", 1))
    number = F.regexp_extract("entry", r"^([^\s=]+)\s*(?:=|\s)\s*(\S+)$", 2)
    weight = number.try_cast("double")
    error = F.when(name == "", "not a pair").when(weight.isNull(), "weight is not numeric")
    return rows.withColumns({"ticker": name, "weight": weight, "error": error})
