"""Connected components by contraction, and fixed-size tables merged from all tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import BROADCAST_ROWS, lean

SLICES = 64


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node of its component.

    In a round every node points to its smallest neighbour if that is smaller; pointers are followed three times,
    edges are moved to where their ends point, and loops and repeats go. At least half of the nodes go in each
    round, so rounds grow with the logarithm of the longest path. Aggregates are partial (a hub's neighbours never meet
    in one row) and joins on hubs are left to the skew handling of shuffled joins."""
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialise(nodes.withColumn("root", F.col("node")), name)
    while not edges.isEmpty():
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).union(edges.select("a", F.col("a")))
        first = point = materialise(ends.groupBy("node").agg(F.min("to").alias("to")), name)
        for _ in range(3):
            on = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            point = point.join(on, "to").select("node", F.col("next").alias("to"))
        point = materialise(point, name)
        moved = edges.join(point.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(point.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        spent = [edges, first, point, labels]
        edges = materialise(moved.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), name)
        labels = labels.join(point.select(F.col("node").alias("root"), F.col("to").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = materialise(labels, name)
        for table in spent:
            discard(table)
    return labels


def sliced(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A task's table as (slice, compressed bytes)."""
    for i, part in enumerate(np.split(table, SLICES)):
        if part.any():
            yield i, zlib.compress(part.tobytes(), 1)


def merged_slices(parts: DataFrame, size: int, kind: type, add: Callable, last: Callable) -> np.ndarray:
    """The tables of all tasks, given as rows (slice, blob), put together by `add` and shrunk by `last`; a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(last(total).tobytes(), 1)], pa.binary())], names=["slice", "blob"])

        for batch in batches:
            for i, blob in zip(batch.column("slice").to_pylist(), batch.column("blob"), strict=True):
                part = np.frombuffer(zlib.decompress(blob.as_py()), dtype=kind)
                if i != at:  # slices come one after the other
                    if at is not None:
                        yield done()
                    at, total = i, part.astype(np.uint64)
                else:
                    total = add(total, part)
        if at is not None:
            yield done()

    return _table(parts.select("slice", "blob").repartition("slice").sortWithinPartitions("slice").mapInArrow(lean(run), "slice int, blob binary"), size)


#: Keys up to which a filter of them may be broadcast: 2^28 bits at most. Beyond, callers join.
FILTER_KEYS = 1 << 24


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the one column of keys, n of them and no more than FILTER_KEYS: two places a key among 8 to 16 bits a key.

    It lets rows through that the join or comparison after it drops. Places are shuffled, not tables, so that what is
    moved grows with the keys and not with the tasks; a task holds one of SLICES parts of the table."""
    if n > FILTER_KEYS:
        raise ValueError("too many keys for a broadcast filter")
    bits = max(20, (8 * n).bit_length())
    each = (1 << bits) // SLICES

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(_slots(np.asarray(batch.column(0)), bits))))
            cut = np.searchsorted(at, np.arange(SLICES + 1) * each)
            rows = [(i, (at[lo:hi] - i * each).astype("<u4").tobytes()) for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["slice", "blob"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(np.packbits(part).tobytes(), 1)], pa.binary())], names=["slice", "blob"])

        for batch in batches:
            for i, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if i != at:  # slices come one after the other
                    if at is not None:
                        yield done()
                    at, part = i, np.zeros(each, dtype=bool)
                part[np.frombuffer(blob, "<u4")] = True
        if at is not None:
            yield done()

    sent = keys.mapInArrow(lean(places), "slice int, blob binary").repartition("slice").sortWithinPartitions("slice")
    return _table(sent.mapInArrow(lean(build), "slice int, blob binary"), (1 << bits) // 8)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among those of gone (one column, each id once).

    Beyond what may be broadcast, a filter of the ids tells most of the rows that stay where they lie, so that texts
    aren't shuffled; only rows that the filter lets through meet the ids in a join."""
    n = gone.count()
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(gone), "doc_id", "left_anti").select(docs.columns)
    if n > FILTER_KEYS:
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(gone, n))

    @F.pandas_udf("boolean")
    def may_go(ids: pd.Series) -> pd.Series:
        return pd.Series(in_filter(sent.value, ids.to_numpy()))

    named = F.col("doc_id").isNotNull()
    asked = may_go(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    stay = docs.filter(~named | ~asked)
    return stay.unionByName(docs.filter(named & asked).join(gone, "doc_id", "left_anti").select(docs.columns))


def _table(slices: DataFrame, size: int) -> np.ndarray:
    """The bytes of a table from its SLICES rows."""
    out = np.zeros(size, dtype=np.uint8)
    each = size // SLICES
    for row in slices.collect():
        out[row["slice"] * each : (row["slice"] + 1) * each] = np.frombuffer(zlib.decompress(row["blob"]), dtype=np.uint8)
    return out


def in_filter(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    found = np.ones(len(keys), dtype=bool)
    for at in _slots(keys, (len(table) * 8).bit_length() - 1):
        found &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return found


def _slots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = keys.astype(np.int64).view(np.uint64) * np.uint64(odd)
        yield (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)
