"""Schemas inferred from all rows of a text source, held against a stored contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types from the narrowest to the widest that holds it (fixed order); text holds all.
WIDTH = ["boolean", "int", "bigint", "double", "date", "timestamp", "string"]


def inferred(spark: SparkSession, path: str, kind: str, **options: str) -> T.StructType:
    """The schema of CSV or JSON lines from every row; nothing is sampled."""
    reader = spark.read.options(**options).option("samplingRatio", "1.0")
    if kind == "csv":
        return reader.option("header", "true").option("inferSchema", "true").option("preferDate", "true").csv(path).schema
    if kind == "json":
        return reader.json(path).schema
    raise ValueError("a scanned source is csv or json")


def drift(spark: SparkSession, found: T.StructType, contract: str) -> DataFrame:
    """(column, change, agreed, found): columns that were added or lost, and types that became wider, narrower or another.

    No row: the source is as agreed. A column without any value, which CSV
    takes for text, is reported like others.
    """
    agreed = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(contract)}
    now = {f.name: f.dataType.simpleString() for f in found}
    rows = []
    for name in sorted({*agreed, *now}):
        a, b = agreed.get(name), now.get(name)
        if a == b:
            continue
        if a is None or b is None:
            change = "added" if a is None else "lost"
        elif a in WIDTH and b in WIDTH:
            change = "widened" if WIDTH.index(b) > WIDTH.index(a) else "narrowed"
        else:
            change = "changed"
        rows.append((name, change, a, b))
    return spark.createDataFrame(rows, "column string, change string, agreed string, found string").coalesce(1)


def scan(spark: SparkSession, path: str, kind: str, contract: str, **options: str) -> DataFrame:
    """The source under its contract, if it has not drifted; a narrower type is read as agreed, anything else is refused."""
    found = drift(spark, inferred(spark, path, kind, **options), contract)
    bad = found.where(F.col("change").isin("added", "widened", "changed", "lost")).collect()
    if bad:
        raise ValueError("the source has drifted: " + ", ".join(f"{r['column']} {r['change']}" for r in bad))
    reader = spark.read.options(**options).schema(contract)
    return reader.option("header", "true").csv(path) if kind == "csv" else reader.json(path)
