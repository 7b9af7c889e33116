"""The node relation in DataFrame form: ancestry is a comparison of pre-order numbers under an equal page_id.

Every join carries page_id, so that once nodes are dealt by it all of these run without another shuffle of theirs; a
join's size is bounded by the pages' depth times the smaller side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def prefixed(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(c if c == "page_id" else f"{prefix}_{c}") for c in nodes.columns])


def inside(a: str, d: str) -> Column:
    """d is a, or below it."""
    return F.col(f"{d}_node_id").between(F.col(f"{a}_node_id"), F.col(f"{a}_last_id"))


def descendants(above: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a_*, d_* of each node of `above` and each node strictly below it."""
    return prefixed(above, "a").join(prefixed(nodes, "d"), "page_id").filter(inside("a", "d") & (F.col("d_node_id") > F.col("a_node_id")))


def children(above: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a_*, c_* of nodes and their children: an equi-join."""
    a, c = prefixed(above, "a"), prefixed(nodes, "c")
    return a.join(c, (a["page_id"] == c["page_id"]) & (F.col("a_node_id") == F.col("c_parent_id"))).drop(c["page_id"])


def detach(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes outside the subtrees of the roots (page_id, node_id, last_id)."""
    r = roots.select("page_id", F.col("node_id").alias("_lo"), F.col("last_id").alias("_hi"))
    return nodes.join(r, (nodes["page_id"] == r["page_id"]) & nodes["node_id"].between(F.col("_lo"), F.col("_hi")), "left_anti")


def text_content(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, text) of each element: its text nodes in document order."""
    texts = nodes.filter("kind = 'text'").select("page_id", "node_id", "text")
    pairs = descendants(elements, texts).select("page_id", F.col("a_node_id").alias("node_id"), F.struct("d_node_id", "d_text").alias("t"))
    joined = pairs.groupBy("page_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["d_text"]), "").alias("text"))
    return elements.select("page_id", "node_id").join(joined, ["page_id", "node_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def descendant_counts(above: DataFrame, nodes: DataFrame, tags: list[str]) -> DataFrame:
    """(page_id, node_id, n) of each node of `above`: how many elements with one of the tags stand below it."""
    found = descendants(above.select("page_id", "node_id", "last_id"), nodes.filter(F.col("tag").isin(tags)).select("page_id", "node_id"))
    n = found.groupBy("page_id", F.col("a_node_id").alias("node_id")).agg(F.count("*").alias("n"))
    return above.select("page_id", "node_id").join(n, ["page_id", "node_id"], "left").na.fill(0, ["n"])


def container_scores(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, tag, score, block_count) of each element below the body that holds a block (page_id, node, length):
    the blocks' lengths, 200 for an article or main, 60 for each heading."""
    boxes = nodes.filter((F.col("kind") == "element") & ~F.col("tag").isin("html", "body")).select("page_id", "node_id", "last_id", "tag")
    b = blocks.select("page_id", F.col("node").alias("node_id"), "length")
    held = descendants(boxes, b).groupBy("page_id", F.col("a_node_id").alias("node_id")).agg(F.sum("d_length").alias("chars"), F.count("*").alias("block_count"), F.first("a_tag").alias("tag"), F.first("a_last_id").alias("last_id"))
    heads = descendant_counts(held, nodes, HEADINGS)
    bonus = F.when(F.col("tag").isin("article", "main"), 200).otherwise(0)
    return held.join(heads, ["page_id", "node_id"]).select("page_id", "node_id", "tag", (F.col("chars") + bonus + 60 * F.col("n")).alias("score"), "block_count")


def common_ancestor(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs(page_id, x, y) with lca: the deepest element above x that is y or above it."""
    up = nodes.filter("kind = 'element'").select("page_id", "node_id", "last_id", "depth")
    both = pairs.join(up, "page_id").filter((F.col("node_id") < F.col("x")) & (F.col("x") <= F.col("last_id")) & F.col("y").between(F.col("node_id"), F.col("last_id")))
    found = both.groupBy("page_id", "x", "y").agg(F.max_by("node_id", "depth").alias("lca"))
    return pairs.join(found, ["page_id", "x", "y"], "left")


def longest_block_run(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, parent_id, blocks): the parent of the longest run of blocks that share one, the first of equal runs."""
    w = Window.partitionBy("page_id").orderBy("node_id")
    b = blocks.select("page_id", F.col("node").alias("node_id")).join(nodes.select("page_id", "node_id", "parent_id"), ["page_id", "node_id"])
    runs = b.withColumn("_new", F.when(F.lag("parent_id").over(w) == F.col("parent_id"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = runs.groupBy("page_id", "_run").agg(F.first("parent_id").alias("parent_id"), F.count("*").alias("blocks"))
    return runs.groupBy("page_id").agg(F.max_by(F.struct("parent_id", "blocks"), F.struct(F.col("blocks"), -F.col("_run"))).alias("r")).select("page_id", "r.*")
