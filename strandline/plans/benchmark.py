"""The benchmark: every arm over every case, checked, timed out, scored and reported."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score
from ..operators.verdict import CONTENTFUL, with_checks, with_outcomes, with_timeout
from ..session import materialise
from ..streaming.events import add_new
from .arms import ARMS

KEYS = ["task_id", "attempt_id", "step_id"]


def run_arms(truths: DataFrame, responses: DataFrame, arms: list[str] | None = None) -> DataFrame:
    """Outcomes of each arm and case. Each arm starts from the first visit of every URL."""
    requests = truths.select(F.col("case_id").alias("request_id"), F.col("target").alias("url"))
    out = None
    for name in arms or list(ARMS):
        rows = ARMS[name](requests, responses).withColumn("subject_id", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    out = with_timeout(out.withColumnRenamed("request_id", "case_id"))
    return materialise(with_improvements(with_outcomes(with_checks(out.join(truths, "case_id")))), "outcomes")


def with_improvements(outcomes: DataFrame) -> DataFrame:
    """Each escalation's `improved`: whether the lane that it names has content for the case in this run; null if no arm ran it."""
    lanes = outcomes.groupBy("case_id", "lane").agg(F.bool_or(F.col("status").isin(CONTENTFUL)).alias("has"))
    lanes = lanes.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("lane", "has"))).alias("_lanes"))  # a few lanes
    filled = F.transform("escalations", lambda e: e.withField("improved", F.try_element_at("_lanes", e["to_lane"])))
    return outcomes.join(lanes, "case_id").withColumn("escalations", filled).drop("_lanes")


def markdown_report(outcomes: DataFrame, title: str, subjects: list[str]) -> str:
    """The run as Markdown: tiers or scores, the case by arm grid, the challenge tally. The tables are a few rows."""

    def table(df: DataFrame) -> str:
        lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in row) + " |" for row in df.collect()])

    tiers = score.tier_report(outcomes).orderBy("subject_id", "tier")
    first = tiers if not tiers.isEmpty() else score.suite_scores(outcomes).orderBy("subject_id")
    parts = [f"# {title}", "## Scores", table(first), "## Cases", table(score.case_by_arm(outcomes, subjects).orderBy("case_id")), "## Challenge check", table(score.challenge_tally(outcomes).orderBy("subject_id"))]
    return "\n\n".join(parts) + "\n"


def console_lines(outcomes: DataFrame) -> list[str]:
    """A few lines for each arm."""
    rate = lambda r: "N/A" if r is None else f"{100 * r:.1f}%"
    return [
        f"{r.subject_id}: {r.case_count} cases, {r.status_match_count} status matches, {r.contentful_count} contentful, {r.false_success_count} false successes ({rate(r.false_success_rate)}), median {r.median_wall_ms} ms, {r.budget_violations} over budget"
        for r in score.suite_scores(outcomes).orderBy("subject_id").collect()
    ]


def write_run(outcomes: DataFrame, path: str) -> None:
    """Outcomes, scores and tallies as Parquet, one folder each; the scores also as JSON lines, and each content as an artifact."""
    for name, df in (("outcomes", outcomes), ("scores", score.suite_scores(outcomes)), ("tallies", score.check_tallies(outcomes)), ("lanes", score.lane_distribution(outcomes))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    score.suite_scores(outcomes).write.mode("overwrite").json(f"{path}/scores.json")
    content = F.struct(F.sha2(F.encode("markdown", "UTF-8"), 256).alias("sha256"), F.octet_length("markdown").alias("bytes"), "markdown")
    outcomes.filter("markdown is not null").select("subject_id", "case_id", content.alias("artifact")).select("subject_id", "case_id", "artifact.*").write.mode("overwrite").partitionBy("subject_id").parquet(f"{path}/artifacts")


def upsert_steps(steps: DataFrame, path: str, writer: str = "writer") -> None:
    """Adds rows keyed (task_id, attempt_id, step_id) that the table at path lacks; a repeated write changes nothing.

    Each call writes a folder of its own, named by the writer and what it wrote, so two writers don't touch each other's files;
    a key that both add is read once by `read_steps`."""
    add_new(steps, path, KEYS, f"{writer}-{uuid.uuid4().hex}")


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """The steps, each key once: of rows that two writers added at one time, the one of the first writer by name."""
    rows = spark.read.parquet(path)
    first = rows.groupBy(*KEYS).agg(F.min("version").alias("version"))
    return rows.join(first, [*KEYS, "version"]).drop("version").dropDuplicates(KEYS)
