"""Order-dependent logic as windows and aggregates: runs, dominance, attempts, elapsed time, chunks, duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens


def longest_run(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Of each group the longest run of rows that follow each other with one value; the first of equal ones."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(by, "_run").agg(F.first(value).alias(value), F.count("*").alias("run_length"), F.min(order).alias("run_start"))
    return runs.groupBy(by).agg(F.max_by(F.struct(value, "run_length", "run_start"), F.struct(F.col("run_length"), -F.col("_run"))).alias("r")).select(by, "r.*")


def best_and_runner_up(scored: DataFrame, by: str, key: str, score: str) -> DataFrame:
    """The two best of each group and whether the first leads by two fifths (or has no rival). Ties go to the smaller key."""
    top = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))
    two = scored.withColumn("_r", top).filter("_r <= 2")
    best, second = F.max(F.when(F.col("_r") == 1, F.struct(key, score))), F.max(F.when(F.col("_r") == 2, F.struct(key, score)))
    out = two.groupBy(by).agg(best.alias("b"), second.alias("s"))
    dominant = F.coalesce(F.col(f"s.{score}"), F.lit(0)) == 0
    return out.select(by, F.col(f"b.{key}").alias("best"), F.col(f"b.{score}").alias("best_score"), F.col(f"s.{key}").alias("runner_up"), F.col(f"s.{score}").alias("runner_up_score"), (dominant | (F.col(f"b.{score}") >= F.col(f"s.{score}") * 1.4)).alias("dominates"))


def attempt_number(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def trace_elapsed(rows: DataFrame, by: str, ts: str) -> DataFrame:
    """Milliseconds since the first event of the group."""
    micros = lambda c: F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), "UTC"))
    return rows.withColumn("elapsed_ms", F.floor((micros(F.col(ts)) - micros(F.min(ts).over(Window.partitionBy(by)))) / 1000).cast("long"))


def content_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, content hash, the smallest key of the same content, and whether the row is it."""
    hashed = docs.select(key, F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))
    return hashed.join(first, "content_hash").withColumn("is_first", F.col(key) == F.col("first_key"))


def normalised_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameters, other parameters sorted."""
    base = F.lower(F.regexp_extract(url, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1))
    base = F.regexp_replace(F.regexp_replace(base, r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    query = F.filter(F.array_sort(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid|ref)="))
    return F.concat(base, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def identical_streak(rows: DataFrame, by: str, order: str, fingerprint: str, stop: int = 3) -> DataFrame:
    """How many equal fingerprints stand in a row at each step, and whether that many end the crawl."""
    w = Window.partitionBy(by).orderBy(order)
    changed = F.when(F.lag(fingerprint).over(w).eqNullSafe(F.col(fingerprint)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = rows.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(w))
    rows = rows.withColumn("streak", F.row_number().over(Window.partitionBy(by, "_run").orderBy(order)))
    return rows.withColumn("loop_detected", F.col("streak") >= stop).drop("_changed", "_run")


def paragraph_chunks(docs: DataFrame, key: str, text: str, budget: int = 512) -> DataFrame:
    """Lines of each text packed into chunks of about budget tokens: a line belongs to the chunk in which it begins.

    One window over a text's own lines; provenance is the first and last line, and the offset where the budget first cuts."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "part")).withColumn("tokens", F.coalesce(estimate_tokens(F.col("part")), F.lit(0)))
    w = Window.partitionBy(key).orderBy("line")
    before = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("chunk", F.floor(before / budget).cast("int"))
    return lines.groupBy(key, "chunk").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.sum("tokens").alias("tokens"), F.count("*").alias("lines"))


def truncate_to_tokens(text: Column, budget: int) -> Column:
    """struct(text, truncated, truncated_at): the longest beginning whose token estimate is within the budget, with its length.

    A character has a quarter of a token at least, so only the first 4 * budget characters are looked at; the place
    is found by halving, as the estimate never falls when a text grows."""
    head = F.left(text, F.lit(4 * budget))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((4 * budget).bit_length()))])
    fits = lambda n: (n <= F.length(head)) & (estimate_tokens(F.left(head, n)) <= budget)
    at = F.aggregate(steps, F.lit(0), lambda done, step: F.when(fits(done + step), done + step).otherwise(done))
    cut = (F.length(text) > 4 * budget) | (estimate_tokens(head) > budget)
    return F.struct(F.when(cut, F.left(text, at)).otherwise(text).alias("text"), cut.alias("truncated"), F.when(cut, at).alias("truncated_at"))


def heading_chunks(docs: DataFrame, key: str, text: str, budget: int = 512, overlap: int = 0) -> DataFrame:
    """(key, chunk, first_line, last_line, n_lines, tokens, path) of Markdown texts cut at headings.

    A line that begins with one to six # and a space starts a section, outside fenced code; path is the section's heading and those
    above it, from the top. Inside a section, lines are packed up to the budget: a line goes to the chunk that its
    running count falls into, so a chunk is over the budget by less than its last line. With overlap, a chunk after the
    first of its section also has the lines before it that reach back over at most so many tokens. Two windows over a text's own lines."""
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("line", "part"))
    lines = lines.withColumn("tokens", F.coalesce(estimate_tokens(F.col("part")), F.lit(0)))
    w = Window.partitionBy("key").orderBy("line")
    fence = F.sum(F.col("part").rlike(r"^\s*(```|~~~)").cast("int")).over(w)
    level = F.when((fence % 2 == 0) & F.col("part").rlike(r"^#{1,6} "), F.length(F.regexp_extract("part", "^#+", 0)))
    lines = lines.withColumn("level", level).withColumn("section", F.count("level").over(w))
    inside = Window.partitionBy("key", "section").orderBy("line")
    before = F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("upto", before).withColumn("part_no", F.floor(F.col("upto") / budget).cast("int"))
    heads = lines.filter("level is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("section", "level", F.regexp_replace("part", r"^#+\s*", "").alias("title")))).alias("heads"))
    own = lines.groupBy("key", "section", "part_no").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.sum("tokens").alias("own_tokens"), F.min("upto").alias("begin"))
    back = lines.select("key", "section", "line", "upto", "tokens").withColumnsRenamed({"line": "_line", "upto": "_upto", "tokens": "_tokens", "key": "_key", "section": "_section"})
    near = (F.col("key") == F.col("_key")) & (F.col("section") == F.col("_section")) & (F.col("_upto") < F.col("begin")) & (F.col("_upto") >= F.col("begin") - overlap) & (F.col("_line") < F.col("first_line"))
    own = own.join(back, near, "left").groupBy("key", "section", "part_no", "first_line", "last_line", "own_tokens").agg(F.min("_line").alias("_from"), F.coalesce(F.sum("_tokens"), F.lit(0)).alias("_more"))
    own = own.withColumns({"first_line": F.coalesce("_from", "first_line"), "tokens": F.col("own_tokens") + F.col("_more")}).join(heads, "key", "left")
    # The headings up to the section's, of which those stay that no later one of the same or a higher level closes.
    upto = F.filter("heads", lambda h: h["section"] <= F.col("section"))
    path = F.filter(upto, lambda h: ~F.exists(upto, lambda k: (k["section"] > h["section"]) & (k["level"] <= h["level"])))
    numbered = F.row_number().over(Window.partitionBy("key").orderBy("section", "part_no")) - 1
    return own.select(
        F.col("key").alias(key), numbered.alias("chunk"), "first_line", "last_line", (F.col("last_line") - F.col("first_line") + 1).alias("n_lines"), "tokens",
        F.coalesce(F.array_join(F.transform(path, lambda h: h["title"]), " > "), F.lit("")).alias("path"))


def word_set(text: Column) -> Column:
    """A text's different words, lower-case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def likeness(docs: DataFrame, probes: DataFrame, on: str, text: str, probe: str) -> DataFrame:
    """docs with similarity, the Jaccard similarity of the text's words and its probe's word set: how alike a page is to
    the site's answer for a page that cannot exist. probes(on, probe) has a row for each site; it is broadcast if it is small.

    A union's size follows from the overlap's, so words are matched once."""
    if probes.limit(10_001).count() <= 10_000:
        probes = F.broadcast(probes)
    rows = docs.join(probes, on).withColumn("_words", word_set(F.col(text)))
    rows = rows.withColumn("_both", F.size(F.array_intersect("_words", probe)))
    all_ = F.size("_words") + F.size(probe) - F.col("_both")
    return rows.withColumn("similarity", F.when(all_ > 0, F.col("_both") / all_).otherwise(0.0)).drop("_words", "_both", probe)


def containing(docs: DataFrame, needles: DataFrame, key: str, text: str, needle_key: str, needle: str, block: int = 16 << 20) -> DataFrame:
    """(needle_key, key) of each needle that stands in a text, by one scan of the texts for each block of needles.

    A block's needles, about `block` characters of them (so that what is broadcast has a bound), make one Aho-Corasick
    automaton; a text is read once whatever their number. Nothing is exploded or joined, and any length
    of needle will do: an empty one stands in every text. Null texts and null needles match nothing."""
    spark = docs.sparkSession
    given = needles.filter(F.col(needle).isNotNull()).select(needle_key, needle)
    total = given.agg(F.coalesce(F.sum(F.length(needle) + 8), F.lit(0))).first()[0]
    blocks = -(-total // block)
    kinds = {f.name: f.dataType.simpleString() for f in given.select(needle_key).schema} | {f.name: f.dataType.simpleString() for f in docs.select(key).schema}
    schema = f"`{needle_key}` {kinds[needle_key]}, `{key}` {kinds[key]}"
    out = None
    for i in range(blocks):
        part = given if blocks == 1 else given.filter(F.pmod(F.xxhash64(needle_key, needle), F.lit(blocks)) == i)
        some: dict[str, list] = {}
        for k, x in part.collect():  # one block
            some.setdefault(x, []).append(k)
        sent = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for x in sent.value:
                if x:
                    automaton.add_word(x, x)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    if t is None:
                        continue
                    hits = {x for _, x in automaton.iter(t)} if len(automaton) else set()
                    for x in hits | ({""} & sent.value.keys()):
                        found += sent.value[x]
                        at += [i] * len(sent.value[x])
                yield pa.RecordBatch.from_arrays([pa.array(found, arrow[0].type), batch.column(0).take(pa.array(at, pa.int64()))], names=[needle_key, key])

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(given.select(needle_key).schema)
        pairs = docs.select(key, text).mapInArrow(run, schema)
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else spark.createDataFrame([], schema)
