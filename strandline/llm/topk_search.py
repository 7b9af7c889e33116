"""Exact top-k inner-product search by a pivot table.

Vectors become whole numbers, floor(256 * x). With one more coordinate sqrt(M - |x|^2), M the largest squared
norm, all have one length, and the largest inner product is the smallest distance. Every vector's distances
to `pivots` pivots are computed once and stored. For a query, |d(q,p) - d(x,p)| never exceeds d(q,x), so the
maximum over the pivots is a lower bound. Candidates are scored in the order of their bounds until the next
bound is beyond the k-th best distance; ties go to the smaller vec_id, so equal bounds are still scored.

Queries go in blocks of a bounded size, each against all rows; a block's thresholds start from the exact
scores of a bounded sample, so most rows fall to their bound alone. Each task returns k rows for a query
at most. A block's result is written before the next begins, so the plan doesn't grow with the queries.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without a vec_id.
Only vectors of one length meet; empty vectors all score 0. Rows that repeat the query's own vec_id count as
its own; other repeated rows are candidates each. Query rows that repeat both vec_id and vector are one query; of
one vec_id with several vectors each is a query, with ranks of its own. Other columns are not looked at. Scores must stay below 2^53."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import local_rows, materialise

K, PIVOTS, SAMPLE, BLOCK = 5, 32, 1024, 1024
#: Queries whose bounds against one batch are held at once, and candidates scored at once.
QUERIES_AT_ONCE, SCORED_AT_ONCE = 32, 256


def whole_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the rows whose vector takes part."""
    x = F.col(column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * 256))
    return rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(x).alias("dim"))


def matrix(column: pd.Series | list, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column], dtype=np.float64).reshape(len(column), dim)


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, largest: float, pivots: np.ndarray) -> np.ndarray:
    """From each vector to each pivot, in the lifted space. x may come lifted."""
    if x.shape[1] < pivots.shape[1]:
        x = np.column_stack([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))])
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0))


def pivot_table(vectors: DataFrame, dim: int, largest: float, pivots: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            table = distances(matrix(batch["v"], dim), largest, pivots).astype(np.float32)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "d": list(table)})

    return materialise(vectors.select("vec_id", "v").mapInPandas(run, "vec_id long, v array<long>, d array<float>"), "pivot_table")


class Best:
    """The k best (score, vec_id) of one query so far, best first."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.score, self.id = np.empty(0), np.empty(0, dtype=np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor
        score, ids = np.concatenate([self.score, score[keep]]), np.concatenate([self.id, ids[keep]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]
        if len(order) == self.k:
            self.floor = max(self.floor, self.score[-1])


def search_block(table: DataFrame, dim: int, largest: float, pivots: np.ndarray, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> DataFrame:
    """(query, query_id, vec_id, score) of each task's best for each query of the block; `query` numbers the block's queries."""
    norms = (q * q).sum(1)
    lifted = np.column_stack([q, np.zeros(len(q))])
    to_pivots = distances(lifted, largest, pivots).astype(np.float32)
    slack = 1e-4 * (np.sqrt(largest) + np.sqrt(norms.max(initial=0)) + 1)  # of 32-bit distances
    sent = table.sparkSession.sparkContext.broadcast((ids, q, norms, to_pivots, floors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, norms, to_pivots, floors = sent.value
        best = [Best(k, f) for f in floors]
        for batch in batches:
            x, xid, d = matrix(batch["v"], dim), batch["vec_id"].to_numpy(), np.ascontiguousarray(matrix(batch["d"], to_pivots.shape[1]).astype(np.float32).T)
            for lo in range(0, len(ids), QUERIES_AT_ONCE):
                some = slice(lo, lo + QUERIES_AT_ONCE)
                bound = np.zeros((len(ids[some]), len(x)), dtype=np.float32)
                for p in range(len(d)):
                    np.maximum(bound, np.abs(to_pivots[some, p][:, None] - d[p][None]), out=bound)
                for i, b in enumerate(bound, lo):
                    radius = lambda i=i: np.sqrt(max(0.0, norms[i] + largest - 2 * best[i].floor)) + slack if best[i].floor > -np.inf else np.inf
                    left = np.flatnonzero((b <= radius()) & (xid != ids[i]))
                    left = left[np.argsort(b[left], kind="stable")]
                    for at in range(0, len(left), SCORED_AT_ONCE):
                        if b[left[at]] > radius():
                            break
                        part = left[at : at + SCORED_AT_ONCE]
                        best[i].add(x[part] @ q[i], xid[part])
        for i, found in enumerate(best):
            if len(found.id):
                yield pd.DataFrame({"query": i, "query_id": ids[i], "vec_id": found.id, "score": found.score.astype(np.int64)})

    return table.mapInPandas(run, "query int, query_id long, vec_id long, score long")


def topk_search(rows: DataFrame, is_query, k: int = K, pivots: int = PIVOTS, block: int = BLOCK, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each row for which is_query holds, over all rows."""
    vectors = materialise(whole_vectors(rows, column), "vectors")
    spark = rows.sparkSession
    schema, path, written = "query_id long, rank int, vec_id long, score long", f"{scratch_dir(spark)}/top_k-{uuid.uuid4().hex}", False
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    for (dim,) in vectors.select("dim").distinct().collect():  # one row for each length of vectors
        same = vectors.filter(F.col("dim") == dim)
        square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
        largest = same.agg(F.max(square)).first()[0]
        sample = same.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
        s, sid = matrix(sample["v"], dim), sample["vec_id"].to_numpy()
        chosen = spread(np.column_stack([s, np.sqrt(np.maximum(largest - (s * s).sum(1), 0))]), pivots)
        table = pivot_table(same, dim, largest, chosen)
        queries = same.filter(is_query).dropDuplicates(["vec_id", "v"])
        blocks = -(-queries.count() * 5 // (block * 4))  # hashed: blocks come out a little uneven
        for i in range(blocks):
            part = queries.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == i).toPandas()
            if part.empty:
                continue
            q, ids = matrix(part["v"], dim), part["vec_id"].to_numpy()
            score = np.where(ids[:, None] == sid[None], -np.inf, q @ s.T)
            floors = np.sort(score, axis=1)[:, -k] if len(sid) >= k else np.full(len(ids), -np.inf)
            found = search_block(table, dim, largest, chosen, ids, q, floors, k)
            found.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            written = True
    return spark.read.schema(schema).parquet(path) if written else local_rows(spark, [], schema)


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.v AS query, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
