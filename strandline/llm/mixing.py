"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Sources in code point order, null last, carry the given weights in turn and share `share` of all sizes.
A target stops at `epochs` times its source's size; the excess goes to the other sources by weight, again
until no source is above its cap. Then every document is taken for each whole repetition, and a seeded
order of the documents is walked for the fractional one: documents before the cut are taken once more, the
one at the cut gives the words that are still missing. So a source's words equal its rounded target.

A null text has size 0. Rows that repeat one doc_id stand at one place of the order and share what the cut
leaves to it. Empty tables give empty results; sources of size 0 get target 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, documents, global_rank, materialise

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
RESULTS = ["_size", "_source_size", "_target", "_copies", "_part_words"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: str) -> Column:
    """A document's place in the seeded order: hex digits, the first four of which are its bucket."""
    return F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which sum(least(weight * level, cap)) is total. Each round clamps the sources that the last
    level fills beyond their cap; one row reaches the driver in each."""
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("n")).first()
        if row.n == clamped or not row.weight:
            return level or 0.0
        level, clamped = (total - row.cap) / row.weight, row.n


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of each source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sources, [F.col("source").isNull(), F.col("source")], "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("cap")), "weights")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = F.col("weight") * F.lit(water_level(ranked, share * total))
    return ranked.withColumn("target", F.when(level > F.col("cap"), F.col("cap").cast("double")).otherwise(level))


def mix_plan(sized: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """One row for each source: whole repetitions and the cut of the fractional one.

    Sums of 65,536 buckets of the order find each source's bucket at the cut; only that bucket's rows are sorted."""
    need = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    need = need.withColumn("missing", F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size"))
    placed = sized.withColumn("place", place(seed)).withColumn("bucket", F.substring("place", 1, 4))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("n").over(so_far)).withColumnRenamed("source", "s")
    at = need.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("upto") - F.col("n") < F.col("missing")) & (F.col("missing") <= F.col("upto")))
    at = materialise(at.select("source", "bucket", (F.col("missing") - F.col("upto") + F.col("n")).alias("left")), "cut_buckets")
    small = broadcast_if_small(at.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"))
    rows = placed.join(small, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    rows = rows.groupBy("source", "left", "place").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
    cuts = rows.select(F.col("source").alias("s"), F.col("place").alias("cut"), "n", (F.col("left") - F.col("upto") + F.col("n")).alias("part"))
    return materialise(need.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "weight", "cap", "missing"), "mix_plan")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all by default) with _size, _source_size, _target, _copies and _part_words.

    _copies counts the whole repetitions that a row gives, _part_words the words of one more, partial. Columns of docs that
    have one of these five names give way to it; all others are kept, whatever their names are."""
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    plan = mix_plan(sized, source_targets(sized, weights, share, epochs), seed)
    plan = plan.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("whole").alias("_whole"), F.col("cut").alias("_cut"), F.col("n").alias("_n"), F.col("part").alias("_part"))
    if carry is None:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]).alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("_size"))
    else:
        rows = sized.withColumnRenamed("size", "_size").select(*carry, "source", "_size")
    rows = rows.withColumn("_place", place(seed)).join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("_s")))
    part = F.floor(F.col("_size") * F.col("_part") / F.col("_n"))
    rows = rows.withColumns({
        "_copies": F.col("_whole") + F.when(F.col("_place") < F.col("_cut"), 1).when((F.col("_place") == F.col("_cut")) & (part == F.col("_size")), 1).otherwise(0),
        "_part_words": F.when((F.col("_place") == F.col("_cut")) & (part < F.col("_size")), part).otherwise(0),
    })
    return rows.select("_row.*", *RESULTS) if carry is None else rows.drop("_place", "_s", "_whole", "_cut", "_n", "_part")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, whole; a partial repetition counts from one half of the document."""
    mixed = mix(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text"), **options)
    times = F.col("_copies") + F.when(F.col("_part_words") * 2 >= F.greatest(F.col("_size"), F.lit(1)), 1).otherwise(0)
    return mixed.filter(times > 0).select("_row", F.explode(F.sequence(F.lit(1), times.cast("int")))).select("_row.*")


def op4_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.col("_copies") * F.col("_size") + F.col("_part_words")
    return mix(documents(spark, sf_dir), carry=["doc_id"]).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.cast("long").alias("taken"))


OP4_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM totals),
all_size AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS t FROM s),
levels(step, level, n) AS (
  SELECT 0, (SELECT t FROM all_size) / (SELECT sum(weight) FROM s)::DOUBLE, 0::BIGINT
  UNION ALL
  SELECT * FROM (
    SELECT l.step + 1 AS step,
           ((SELECT t FROM all_size) - coalesce(sum(CASE WHEN s.weight * l.level > s.cap THEN s.cap END), 0)::DOUBLE)
             / sum(CASE WHEN NOT s.weight * l.level > s.cap THEN s.weight END)::DOUBLE AS level,
           count(CASE WHEN s.weight * l.level > s.cap THEN 1 END) AS n
    FROM levels l, s GROUP BY l.step, l.level, l.n
    HAVING count(CASE WHEN s.weight * l.level > s.cap THEN 1 END) <> l.n) x
  WHERE level IS NOT NULL),
top AS (SELECT level FROM levels ORDER BY step DESC LIMIT 1),
targets AS (
  SELECT s.*, CASE WHEN weight * level > cap THEN cap::DOUBLE ELSE weight * level END AS target FROM s, top),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
walked AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.whole,
         CAST(floor(n.target + 0.5) AS BIGINT) - n.whole * n.source_size AS missing,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN need n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, missing - upto + size)) AS BIGINT) AS taken
FROM walked
"""
