"""The five false-success checks and what a case's outcome derives from them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from .pages import expected_table_issues

# Texts of interstitial pages, statuses that carry content, checks in order.
CHALLENGES = ["Just a moment", "Enable JavaScript and cookies", "Checking your browser", "Are you a robot", "Access denied", "Cloudflare Ray ID", "Please wait", "Humans only"]
CONTENTFUL = ["success", "partial"]
CHECKS = ["missing_required_content", "challenge_text_returned", "content_yield_below_floor", "wrong_page_content", "silent_truncation"]
PUBLIC_LANES = ["http", "browser_local"]
CASE_TIMEOUT_MS = 60_000


def missing(needles: Column, text: Column) -> Column:
    return F.filter(needles, lambda s: ~F.contains(text, s))


def challenged(text: Column) -> Column:
    out = F.lit(False)
    for marker in CHALLENGES:
        out = out | F.contains(text, F.lit(marker))
    return F.coalesce(out, F.lit(False))


def challenge_share(text: Column) -> Column:
    """The share of a text that interstitial phrases make up."""
    found = sum(((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) for m in CHALLENGES), F.lit(0))
    return F.when(F.length(text) > 0, found / F.length(text)).otherwise(0.0)


def outcome(failed: Column) -> Column:
    return F.when(failed, "fail").otherwise("pass")


def with_checks(results: DataFrame) -> DataFrame:
    """results (markdown, final_url, requested_url, redirect_chain, truncated, truncated_at) joined with their truth
    (must_contain, must_not_contain, expected_table, expected_main_tokens) plus checks: array<struct<check, outcome, detail>>."""
    md = F.coalesce("markdown", F.lit(""))
    has_text = md != ""
    spec = F.col("expected_table")
    annotated = (F.size("must_contain") > 0) | spec.isNotNull()
    issues = F.coalesce(expected_table_issues(md, spec["columns"], spec["rows"], spec["cells"], spec["same_row"], spec["same_column"], spec["require_markdown"]), F.array().cast("array<string>"))
    lacks = F.concat(missing(F.col("must_contain"), md), F.transform(issues, lambda i: F.concat(F.lit("[table] "), i)))
    first = F.when(annotated & has_text, outcome(F.size(lacks) > 0)).when(annotated, "fail").otherwise("unknown")
    first_says = F.when(annotated & has_text & (F.size(lacks) > 0), F.concat(F.lit("missing: "), F.array_join(lacks, ", "))).when(annotated & ~has_text, "no text where content is required").when(~annotated, "no annotation")
    tokens, floor = estimate_tokens(md), F.col("expected_main_tokens.min")
    banned = F.exists("must_not_contain", lambda s: F.contains(md, s))
    third = F.when(has_text & F.col("expected_main_tokens").isNotNull(), outcome((tokens < floor) | banned)).otherwise("unknown")
    redirected = (F.col("final_url") != F.col("requested_url")) & (F.size("redirect_chain") > 0)
    lost = F.size(missing(F.col("must_contain"), md)) > 0
    fourth = F.when(redirected & (F.size("must_contain") > 0), outcome(lost)).when(redirected, "unknown").otherwise("pass")
    fifth = outcome(F.col("truncated") & F.col("truncated_at").isNull())
    rows = zip(CHECKS, [first, outcome(challenged(md)), third, fourth, fifth], [first_says, F.lit(None), F.when(third == "fail", F.concat(tokens.cast("string"), F.lit(" tokens"))), F.when(fourth != "pass", F.col("final_url")), F.lit(None)], strict=True)
    checks = F.array(*[F.struct(F.lit(c).alias("check"), o.alias("outcome"), d.cast("string").alias("detail")) for c, o, d in rows])
    return results.withColumn("checks", checks)


def with_outcomes(checked: DataFrame) -> DataFrame:
    """Adds status_matched, lane_matched, evaluated_checks, is_false_success and budget_respected."""
    failed = F.exists("checks", lambda c: c["outcome"] == "fail")
    fits = (F.col("wall_ms") <= F.col("budget.max_wall_ms")) & (F.col("attempt_count") <= F.col("budget.max_attempts")) & (F.col("content_tokens").isNull() | (F.col("content_tokens") <= F.col("budget.max_tokens")))
    return checked.withColumns({
        "status_matched": F.col("status") == F.col("expected_status"), "lane_matched": F.col("lane") == F.col("expected_lane"),
        "evaluated_checks": F.transform(F.filter("checks", lambda c: c["outcome"] != "unknown"), lambda c: c["check"]),
        "is_false_success": F.col("status").isin(CONTENTFUL) & failed, "budget_respected": fits})


def with_timeout(results: DataFrame) -> DataFrame:
    """A case that took the time limit or longer becomes a budget_exceeded row: nothing of its answer stays, and its trace is a
    start and a timeout."""
    late = F.col("wall_ms") >= CASE_TIMEOUT_MS
    event = lambda name, detail: F.struct(F.lit(name).alias("event"), F.col("requested_url").alias("url"), F.lit(None).cast("int").alias("status"), F.lit(detail).cast("string").alias("detail"))
    instead = {
        "status": F.lit("budget_exceeded"), "lane": F.lit("http"), "final_url": F.col("requested_url"), "redirect_chain": F.array().cast("array<string>"), "wall_ms": F.lit(CASE_TIMEOUT_MS).cast("long"), "truncated": F.lit(False),
        "bytes_wire": F.lit(0).cast("long"), "bytes_decompressed": F.lit(0).cast("long"), "request_count": F.lit(1), "attempt_count": F.lit(1), "trace": F.array(event("request_start", None), event("timeout", "case_timeout_60s")),
    } | dict.fromkeys(["markdown", "failure_reason", "block_reason", "content_tokens", "http_status", "content_type", "body_sha256", "truncated_at"])
    changed = {c: F.when(late, v if v is not None else F.lit(None)).otherwise(F.col(c)) for c, v in instead.items() if c in results.columns}
    if "escalations" in results.columns:
        changed["escalations"] = F.filter("escalations", lambda e: ~late)
    return results.withColumns(changed | {"budget_exceeded": F.when(late, "time")})
