"""The evidence ledger: CSV files of nine string columns, read as they are and joined into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "id platform date title url evidence_type theme signal confidence".split()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Quotes doubled inside quotes, lines inside fields, a byte order mark in front: all allowed. A fixed schema, no inference."""
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").schema(schema).csv(path)
    return rows.withColumn("id", F.regexp_replace("id", "^﻿", ""))


def union_ledgers(*ledgers: DataFrame) -> DataFrame:
    """All rows; an id that stands more than once is an error, found by one aggregate on the ids alone."""
    out = ledgers[0]
    for more in ledgers[1:]:
        out = out.unionByName(more)
    again = [r["id"] for r in out.groupBy("id").count().filter("count > 1").limit(5).collect()]
    if again:
        raise ValueError(f"ids stand more than once: {again}")
    return out


def cited(citations: DataFrame, ledger: DataFrame) -> DataFrame:
    """citations(id) with their ledger rows; an id without a row is an error."""
    lost = [r["id"] for r in citations.join(ledger, "id", "left_anti").select("id").limit(5).collect()]
    if lost:
        raise KeyError(f"ids without a source: {lost}")
    return citations.join(ledger, "id")
