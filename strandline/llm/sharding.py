"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

The ring has a fixed number of cells; a document falls into one by its id's hash, and a cell belongs to the
next virtual node clockwise. No shard takes more rows than its capacity (all rows over the shards, the
remainder one each), so counts differ by one at most. What a full shard cannot take continues clockwise to
the next virtual node whose shard has room; documents below the capacity never move, which keeps movement
limited. The rounds run on the histogram of cells, whose size is fixed, not on documents. A cell may be cut
between shards, at a row number inside the cell.

Null text has no bytes. A row without a doc_id falls into the cell of its text's hash. Repeated rows each take a slot; rows
alike in doc_id, size and CRC are counted, not sorted, so any number of them does not make a task larger. Other columns are not
looked at. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, local_rows, materialise

CELLS, NODES = 1 << 16, 64
#: Rows that are alike leave their count in runs of so many.
RUN = 1 << 14


def ring(shards: int, cells: int = CELLS, nodes: int = NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    return sorted((int(hashlib.md5(f"shard-{s}/{v}".encode()).hexdigest()[:8], 16) % cells, s) for s in range(shards) for v in range(nodes))


def arcs(spark: SparkSession, points: list[tuple[int, int]], cells: int) -> DataFrame:
    """(cell, node) of every cell: node is the index of the virtual node that the cell belongs to."""
    places = [p for p, _ in points]
    edges = sorted({0, *(p + 1 for p in places if p + 1 < cells)})
    rows = [(lo, hi - 1, bisect_left(places, lo) % len(points)) for lo, hi in zip(edges, [*edges[1:], cells], strict=True)]
    return local_rows(spark, rows, "lo int, hi int, node int").select(F.explode(F.sequence("lo", "hi")).alias("cell"), "node")


def place_cells(histogram: DataFrame, points: list[tuple[int, int]], shards: int) -> DataFrame:
    """(cell, lo, n, shard): rows lo to lo+n-1 of the cell go to the shard.

    In each round the pieces on their way ask the shard of their virtual node. It takes them in order up to its
    capacity, cutting the piece at the limit; then it is full, and what is left goes on to the next open
    shard. Every round but the last fills a shard, so there are as many rounds as shards at most."""
    spark = histogram.sparkSession
    total = histogram.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    owner = F.array(*[F.lit(s) for _, s in points])
    going = histogram.select("cell", F.lit(0).cast("long").alias("lo"), "n", "node")
    placed: list[DataFrame] = []
    open_ = set(room)
    while True:
        onward, last = [], None  # the next node, from each node on, of a shard with room
        for i in reversed(range(2 * len(points))):
            last = i % len(points) if points[i % len(points)][1] in open_ else last
            onward.append(last)
        onward = onward[::-1][: len(points)]
        if any(x is None for x in onward):
            break
        node = F.element_at(F.array(*map(F.lit, onward)), F.col("node") + 1)
        asked = going.withColumn("node", node).withColumn("shard", F.element_at(owner, F.col("node") + 1))
        left = F.element_at(F.array(*[F.lit(room[s]).cast("long") for s in range(shards)]), F.col("shard") + 1)
        order = Window.partitionBy("shard").orderBy(F.md5(F.concat_ws("/", "cell", "lo")), "cell", "lo").rowsBetween(Window.unboundedPreceding, 0)
        asked = asked.withColumn("upto", F.sum("n").over(order)).withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), left - F.col("upto") + F.col("n"))))
        asked = materialise(asked, "ring_round")
        placed.append(asked.filter("take > 0").select("cell", "lo", F.col("take").alias("n"), "shard"))
        for row in asked.groupBy("shard").agg(F.sum("take").alias("take"), F.sum(F.col("n") - F.col("take")).alias("over")).collect():  # one row for each shard
            room[row.shard] -= row["take"]
            if row["over"] > 0:
                open_.discard(row.shard)
        going = asked.filter("n > take").select("cell", (F.col("lo") + F.col("take")).alias("lo"), (F.col("n") - F.col("take")).alias("n"), "node")
        if going.isEmpty():
            break
    out = placed[0] if placed else local_rows(spark, [], "cell int, lo long, n long, shard int")
    for more in placed[1:]:
        out = out.unionByName(more)
    return materialise(out, "ring_pieces")


def shard(docs: DataFrame, shards: int = 16, cells: int = CELLS, nodes: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs."""
    points = ring(shards, cells, nodes)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("text_crc32"))
    known = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("-", F.lit(""), "size", "text_crc32"))
    cell = (F.conv(F.substring(F.md5(known), 1, 8), 16, 10).cast("long") % cells).cast("int")
    rows = rows.groupBy("doc_id", "size", "text_crc32", cell.alias("cell")).agg(F.count("*").alias("times"))
    counts = rows.groupBy("cell").agg(F.sum("times").alias("n"))
    pieces = place_cells(materialise(counts.join(F.broadcast(arcs(docs.sparkSession, points, cells)), "cell"), "ring_cells"), points, shards)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "lo").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    pieces = pieces.withColumn("before", before)
    upto = F.sum("times").over(Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("r", upto - F.col("times"))
    # At most `cells` pieces and one more for each cut: a fixed size.
    pieces = F.broadcast(pieces.withColumnRenamed("cell", "c"))
    placed = numbered.join(pieces, (F.col("cell") == F.col("c")) & (F.col("r") < F.col("lo") + F.col("n")) & (F.col("r") + F.col("times") > F.col("lo")))
    first, last = F.greatest("r", "lo"), F.least(F.col("r") + F.col("times"), F.col("lo") + F.col("n")) - 1
    # Rows that are alike come apart again: in runs, so that no array is long.
    placed = placed.withColumns({"first": first, "last": last}).withColumn("run", F.explode(F.sequence("first", "last", F.lit(RUN).cast("long"))))
    placed = placed.withColumn("r", F.explode(F.sequence("run", F.least(F.col("run") + RUN - 1, F.col("last")))))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("r") - F.col("lo")).cast("long").alias("slot"))


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
