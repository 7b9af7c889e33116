"""Arms: how each crawler turns requests and recorded responses into results of one shape.

An arm is a function (requests, responses) -> results; new ones register under a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators.golden import golden_markdown
from ..operators.pages import extract_pages, markdown_tables
from ..operators.transport import EVENT, resolve
from ..session import materialise

RESULT = "status failure_reason block_reason lane markdown final_url http_status redirect_chain content_type body_sha256 wall_ms bytes_wire bytes_decompressed request_count attempt_count content_tokens escalations truncated truncated_at trace".split()
#: The browser's limit for a page's load.
LOAD_TIMEOUT_MS = 20_000
ARMS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def arm(name: str):
    def register(f: Callable[[DataFrame, DataFrame], DataFrame]):
        ARMS[name] = f
        return f

    return register


def first_answers(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One request each, no redirects followed, no retries; without an answer it is a connection error."""
    once = responses.filter("visit_no = 1").drop("visit_no")
    return requests.join(once, "url", "left").withColumn("error_name", F.when(F.col("status").isNull(), F.coalesce("error_name", F.lit("NoResponse"))).otherwise(F.col("error_name")))


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def results(rows: DataFrame, status: Column, reason: Column, markdown: Column, lane: str = "http", block: Column | None = None, escalated: Column | None = None, chain: Column | None = None) -> DataFrame:
    """rows in the shape of RESULT. Tokens are counted for content only."""
    ok = status == "success"
    step = F.array(F.struct(F.lit("http").alias("from_lane"), F.lit("browser_local").alias("to_lane"), F.lit("extract_low_confidence").alias("trigger"), null("boolean").alias("improved")))
    none = F.filter(step, lambda s: F.lit(False))
    out = rows.withColumns({
        "http_status": F.col("status"), "status": status, "failure_reason": F.when(status == "failed", reason), "block_reason": F.when(status == "blocked", block if block is not None else null("string")), "lane": F.lit(lane),
        "markdown": F.when(ok, markdown), "content_type": F.try_element_at("headers", F.lit("content-type")), "body_sha256": F.sha2(F.encode("body", "UTF-8"), 256),
        "escalations": F.when(escalated, step).otherwise(none) if escalated is not None else none, "truncated": F.lit(False), "truncated_at": null("bigint")})
    if "trace" not in rows.columns:
        broken = F.col("error_name").isNotNull()
        event = F.struct(F.when(broken, "request_failed").otherwise("request_complete").alias("event"), F.col("url"), F.col("http_status").cast("int").alias("status"), F.col("error_name").alias("detail"))
        out = out.withColumn("trace", F.array(event).cast(EVENT))
    for name, value in (("request_count", F.lit(1)), ("attempt_count", F.lit(1)), ("final_url", F.col("url"))):
        if name not in rows.columns:
            out = out.withColumn(name, value)
    out = out.withColumn("redirect_chain", chain if chain is not None else F.array().cast("array<string>"))
    out = out.withColumn("content_tokens", F.when(F.col("status") == "success", estimate_tokens(F.col("markdown"))))
    return out.select("request_id", F.col("url").alias("requested_url"), *RESULT)


def simple(rows: DataFrame) -> tuple[Column, Column]:
    """Status and reason of the arms with plain transport: 200 is the only success, every throw is a connection error."""
    broken = F.col("error_name").isNotNull()
    return F.when(~broken & (F.col("status") == 200), "success").otherwise("failed"), F.when(broken, "connection_error").otherwise("http_error")


@arm("bare-http")
def bare_http(requests: DataFrame, responses: DataFrame) -> DataFrame:
    rows = first_answers(requests, responses)
    status, reason = simple(rows)
    return results(rows, status, reason, F.coalesce("body", F.lit("")))


@arm("golden-converter")
def golden(requests: DataFrame, responses: DataFrame) -> DataFrame:
    rows = first_answers(requests, responses)
    status, reason = simple(rows)
    return results(rows, status, reason, golden_markdown(F.coalesce("body", F.lit(""))))


def extracted(rows: DataFrame, html: Column) -> DataFrame:
    """rows with the extractor's escalate and markdown, read in one pass over the pages."""
    rows = materialise(rows.withColumn("_html", F.coalesce(html, F.lit(""))), "arm_rows")
    found = extract_pages(rows, key="request_id", html="_html").select("request_id", "escalate", markdown_tables("main_html").alias("extracted"))
    return rows.join(found, "request_id").drop("_html")


@arm("extract-tf")
def extract_tf(requests: DataFrame, responses: DataFrame) -> DataFrame:
    rows = extracted(first_answers(requests, responses), F.col("body"))
    status, reason = simple(rows)
    empty = (status == "success") & F.col("escalate")
    return results(rows, F.when(empty, "failed").otherwise(status), F.when(empty, "empty_unverified").otherwise(reason), F.col("extracted"), escalated=empty)


def resilient_status(escalate: Column) -> tuple[Column, Column, Column]:
    """Status, reason and block reason: transport failure, 429, other than 200, nothing extracted, success."""
    failed, code = F.col("failure_reason").isNotNull(), F.col("status")
    status = F.when(failed, "failed").when(code == 429, "blocked").when(code != 200, "failed").when(escalate, "failed").otherwise("success")
    reason = F.when(failed, F.col("failure_reason")).when(code != 200, "http_error").otherwise("empty_unverified")
    return status, reason, F.when(code == 429, "rate_limit")


@arm("resilient-http")
def resilient_http(requests: DataFrame, responses: DataFrame) -> DataFrame:
    rows = extracted(resolve(requests, responses), F.col("body"))
    status, reason, block = resilient_status(F.col("escalate"))
    chain = F.when(F.size("redirect_chain") > 1, F.col("redirect_chain")).otherwise(F.array().cast("array<string>"))
    escalated = (status == "failed") & (reason == "empty_unverified")
    return results(rows, status, reason, F.col("extracted"), block=block, escalated=escalated, chain=chain)


@arm("browser-local")
def browser_local(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Recorded renderings, where there are any; else the body. The chain shows the two ends alone. A page that takes as
    long as the load's limit has failed by then."""
    rows = resolve(requests, responses)
    slow = (F.col("wall_ms") >= LOAD_TIMEOUT_MS) & F.col("failure_reason").isNull()
    rows = rows.withColumns({"failure_reason": F.when(slow, "timeout").otherwise(F.col("failure_reason")), "kind": F.when(slow, "failure").otherwise(F.col("kind")), "wall_ms": F.least("wall_ms", F.lit(LOAD_TIMEOUT_MS).cast("long"))})
    rows = extracted(rows, F.coalesce("rendered_html", "body"))
    status, reason, block = resilient_status(F.col("escalate"))
    chain = F.when(F.col("final_url") != F.col("url"), F.array("url", "final_url")).otherwise(F.array().cast("array<string>"))
    return results(rows, status, reason, F.col("extracted"), lane="browser_local", block=block, chain=chain)
