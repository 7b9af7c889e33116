"""Robots rules: patterns as LIKE expressions, the longest match decides, ties allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like_pattern(pattern: Column) -> Column:
    """A prefix pattern: `*` matches anything, a final `$` ties it to the end, all else is itself. Runs of stars are one."""
    anchored = pattern.endswith("$")
    body = F.regexp_replace(pattern, r"\$$", "")
    body = F.regexp_replace(body, r"([\\%_])", r"\\$1")
    body = F.regexp_replace(body, r"\*+", "%")
    return F.when(anchored, body).otherwise(F.concat(body, F.lit("%")))


def compile_rules(rules: DataFrame) -> DataFrame:
    """rules(host, pattern, allow) with like_pattern and pattern_length."""
    return rules.withColumns({"like_pattern": like_pattern(F.col("pattern")), "pattern_length": F.length("pattern")})


def is_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(host, path, ...) with allowed: the verdict of the longest matching rule of the host; without one, true.

    A host's rules are one array (a robots file is small), so each path meets one row, in one join on the host, and is
    decided where it lies."""
    rule = F.struct(F.col("pattern_length").alias("n"), "allow", "like_pattern")
    compiled = compile_rules(rules).groupBy(F.col("host").alias("_host")).agg(F.collect_list(rule).alias("_rules"))
    hits = F.expr("filter(_rules, r -> path LIKE r.like_pattern ESCAPE '\\\\')")
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))["allow"]
    return paths.join(compiled, F.col("host") == F.col("_host"), "left").withColumn("allowed", F.coalesce(best, F.lit(True))).drop("_host", "_rules")
