"""Scores of arms over outcomes: one grouped aggregate each, with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import upper_median
from .verdict import CHECKS, CONTENTFUL


def suite_scores(outcomes: DataFrame, *segments: str) -> DataFrame:
    """A row for each subject (and segment); the rate is null without contentful rows."""
    contentful = F.count_if(F.col("status").isin(CONTENTFUL))
    false = F.count_if("is_false_success")
    return outcomes.groupBy("subject_id", *segments).agg(
        F.count("*").alias("case_count"), F.count_if("status_matched").alias("status_match_count"), contentful.alias("contentful_count"), false.alias("false_success_count"),
        (false / F.nullif(contentful, F.lit(0))).alias("false_success_rate"), F.coalesce(upper_median("wall_ms"), F.lit(0)).alias("median_wall_ms"),
        F.coalesce(upper_median("wall_ms", 0.95), F.lit(0)).alias("p95_wall_ms"), upper_median("content_tokens").alias("median_content_tokens"),
        F.count_if(~F.col("budget_respected")).alias("budget_violations"))


def check_tallies(outcomes: DataFrame) -> DataFrame:
    """subject, check and the number of passes, fails and unknowns."""
    rows = outcomes.select("subject_id", F.explode("checks").alias("c"))
    return rows.groupBy("subject_id", F.col("c.check").alias("check")).agg(*[F.count_if(F.col("c.outcome") == o).alias(o) for o in ("pass", "fail", "unknown")])


def lane_distribution(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("subject_id", "lane").agg(F.count("*").alias("n"))


def challenge_tally(outcomes: DataFrame) -> DataFrame:
    """Passes, fails and unknowns of the challenge check of each subject."""
    return check_tallies(outcomes).filter(F.col("check") == CHECKS[1]).drop("check")


def tier_report(outcomes: DataFrame) -> DataFrame:
    """A row for each subject and tier; the median time is the subject's over all tiers."""
    tier = F.when(F.startswith("case_id", F.lit("canary2-")), 2).when(F.startswith("case_id", F.lit("canary-")), 1)
    tiers = outcomes.withColumn("tier", tier).filter("tier is not null")
    rows = tiers.groupBy("subject_id", "tier").agg(
        F.count("*").alias("cases"), F.count_if(F.col("status").isin(CONTENTFUL)).alias("contentful"), F.count_if(F.col("status") == "blocked").alias("blocked"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(~F.col("budget_respected")).alias("budget_misses"), upper_median("content_tokens").alias("median_tokens"))
    walls = tiers.groupBy("subject_id").agg(upper_median("wall_ms").alias("median_wall_ms"))
    return rows.join(walls, "subject_id")


def brief(status: str = "status") -> Column:
    """A cell of the case by arm report."""
    return (
        F.when(F.col(status).isin(CONTENTFUL), F.concat(F.lit("ok ("), F.coalesce(F.col("content_tokens").cast("string"), F.lit("0")), F.lit(" tok)")))
        .when(F.col(status) == "blocked", F.concat(F.lit("blocked ("), F.coalesce("block_reason", F.lit("")), F.lit(")")))
        .when(F.col(status) == "budget_exceeded", "budget").otherwise(F.concat(F.lit("failed ("), F.coalesce("failure_reason", F.lit("")), F.lit(")")))
    )


def case_by_arm(outcomes: DataFrame, subjects: list[str]) -> DataFrame:
    """A row for each case, a column for each subject."""
    return outcomes.groupBy("case_id").pivot("subject_id", subjects).agg(F.first(brief()))
