"""Exact dedup by a heavy-hitter split.

Each partition's Misra-Gries summary keeps a bounded number of digests; the merged summaries give every
digest that may hold a large share of all rows. Their counts and winners are verified over all rows, then
broadcast, so the copies of hot texts are decided where they lie. All other digests are shuffled as usual: their
groups are counted by a partial aggregate and joined back, so no group is gathered in a row or a window.

Null text counts as empty text. Texts are equal when they are identical after A-Z are lower-cased. The row
with the largest doc_id stays; of repeated rows that share it all are marked (they are one document).
A null doc_id loses to any other. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, documents, materialise
from .graph import without

#: A digest with more than 1/SHARE of all rows is a heavy hitter.
SHARE = 256


def misra_gries(capacity: int):
    """A function for mapInPandas: the partition's Misra-Gries summary of column digest, at most capacity rows."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, int] = {}
        for batch in batches:
            for digest, n in batch["digest"].value_counts().items():
                kept[digest] = kept.get(digest, 0) + int(n)
            if len(kept) > capacity:  # what the (capacity + 1)-th largest has is taken from all
                less = sorted(kept.values(), reverse=True)[capacity]
                kept = {k: n - less for k, n in kept.items() if n > less}
        if kept:
            yield pd.DataFrame({"digest": list(kept), "estimate": list(kept.values())})

    return summarise


def heavy_hitters(digests: DataFrame, share: int = SHARE) -> DataFrame:
    """(digest, group_size, keep_id) of each digest that may have more than 1/share of the rows, verified.

    A summary of 4*share digests misses at most n/(4*share) of a digest's rows. So every heavy hitter keeps an
    estimate of over 0.75*n/share, and as estimates add up to n at most, no more than 1.34*share rows pass."""
    total = digests.count()
    found = digests.select("digest").mapInPandas(misra_gries(4 * share), "digest string, estimate long").groupBy("digest").agg(F.sum("estimate").alias("estimate"))
    found = found.filter(F.col("estimate") * share > 0.74 * total).select("digest")
    return digests.join(F.broadcast(found), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))


def dedup_groups(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row for each row of docs: doc_id, digest, keep_id, group_size, kept."""
    text = F.encode(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), "UTF-8")
    digests = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest")), "digests")
    heavy = F.broadcast(materialise(heavy_hitters(digests, share), "heavy"))
    hot = digests.join(heavy, "digest")
    rest = digests.join(heavy, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    return hot.unionByName(rest.join(groups, "digest")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows with one doc_id and text, one."""
    groups = materialise(dedup_groups(docs, share), "dedup_groups")
    dropped = groups.filter(~F.col("kept")).select("doc_id").filter(F.col("doc_id").isNotNull())
    again = materialise(groups.filter("kept and group_size > 1").groupBy("doc_id", "digest").count().filter("count > 1").select("doc_id"), "again")
    nameless = F.col("doc_id").isNull()
    both = groups.filter("kept").join(broadcast_if_small(dropped), "doc_id", "left_semi")  # kept with one text, dropped with another
    if groups.filter(nameless).isEmpty() and again.isEmpty() and both.isEmpty():  # the usual case: an anti-join on ids
        return without(docs, dropped.distinct())
    # Ids that are null or repeated: decided by the text itself.
    text = F.sha2(F.encode(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), "UTF-8"), 256)
    kept = groups.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    first = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("digest")).dropDuplicates(["id", "digest"])
    return first.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi").select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
