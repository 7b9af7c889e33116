"""Helpers shared by the corpus operators: scratch tables, ranks, bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import local_rows, materialise

#: Separators between words: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join is broadcast only up to so many rows, counted first.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII takes the fast path, where lower() does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def global_rank(df: DataFrame, order: list[Column], name: str, out: str = "rank") -> DataFrame:
    """Adds the position (from 0) in a total order without sorting in one task.

    Range partitions are written with their number; a rank is the place in the partition plus the rows of
    the partitions before it, a table of one row for each partition."""
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order, strict=True)))
    dealt = materialise(keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return dealt.withColumn("_r", inside).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(out, F.col("_before") + F.col("_r") - 1).drop("_part", "_before", "_r", *keys)


def small(batches, rows: int = 1024):
    """The record batches in slices of at most so many rows, so that what a Python worker derives from one stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_size(batches, most: int = 1 << 19, column: str = "text"):
    """The record batches in slices whose texts have about `most` bytes; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that hands memory back to the system when its task ends, as workers are kept for the next."""

    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # other C libraries
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
