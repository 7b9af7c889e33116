"""Fetching over recorded responses: redirects, loops, limits, one retry of a 503, as joins with the transcript.

A request's state is a row; each step joins the rows still going with responses(url, visit_no, ...), where visit_no is
how often the request has come to the URL. Hops and attempts are bounded, so the steps are too, and rows that end
leave the next join."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

MAX_REDIRECTS, MAX_RETRIES, RETRY_CAP_MS, HEADERS_TIMEOUT_MS, BODY_TIMEOUT_MS = 5, 1, 2000, 10_000, 30_000
RESPONSES = "url string, visit_no int, status int, headers map<string,string>, body string, error_name string, rendered_html string, wall_ms bigint, bytes_wire bigint, bytes_decompressed bigint"
EVENT = "array<struct<event:string,url:string,status:int,detail:string>>"


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, location: pd.Series) -> pd.Series:
    """The location seen from base, or null if it has no meaning."""
    return pd.Series([resolved(b, x) for b, x in zip(base, location, strict=True)], dtype=object)


def resolved(base: str | None, location: str | None) -> str | None:
    """The URL that a location means where base is shown. As browsers do, tabs and line ends in it go, and backslashes
    count as slashes up to a query or fragment."""
    if not location or base is None:
        return None
    location = re.sub(r"[\t\r\n]", "", location).strip("".join(map(chr, range(33))))
    if re.match(r"[\\/]|https?:|[^:/?#]*(?:[\\/?#]|$)", location, re.I):
        head = re.match(r"[^?#]*", location)[0]
        location = re.sub(r"^(https?:)/{2,}", r"\1//", head.replace("\\", "/"), flags=re.I) + location[len(head) :]
    if re.match(r"https?://(?:[?#]|$)", location, re.I):  # no host
        return None
    try:
        out = urljoin(base, location)
        parts = urlsplit(out)
        parts.port  # noqa: B018  raises if it isn't a number
    except ValueError:
        return None
    if not parts.scheme or (parts.scheme in ("http", "https") and not parts.hostname):
        return None
    return out if parts.path or parts.scheme not in ("http", "https") else f"{parts.scheme}://{parts.netloc}/" + (f"?{parts.query}" if parts.query else "")


def retry_after_ms(value: Column) -> Column:
    """Milliseconds of a Retry-After header: any finite number of seconds from 0 on, decimal or with the prefix 0x, 0o or
    0b; blank is 0, no header is null."""
    bare = F.lower(F.trim(value))
    prefixed = F.when(bare.rlike("^0x[0-9a-f]{1,12}$"), F.conv(F.substr(bare, F.lit(3)), 16, 10)).when(bare.rlike("^0o[0-7]{1,15}$"), F.conv(F.substr(bare, F.lit(3)), 8, 10)).when(bare.rlike("^0b[01]{1,50}$"), F.conv(F.substr(bare, F.lit(3)), 2, 10))
    number = F.when((value != "") & (F.trim(value) == ""), F.lit(0.0)).when(F.trim(value).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(value).try_cast("double")).otherwise(prefixed.cast("double"))
    return F.when((number >= 0) & (number < float("inf")), number * 1000)


def header(name: str) -> Column:
    """A header of column headers, whose names are lower case."""
    return F.try_element_at("headers", F.lit(name.lower()))


def resolve(requests: DataFrame, responses: DataFrame, max_redirects: int = MAX_REDIRECTS, max_retries: int = MAX_RETRIES, cap_ms: int = RETRY_CAP_MS) -> DataFrame:
    """requests(request_id, url) with kind (ok, failure), status, failure_reason, final_url, redirect_chain, request_count,
    attempt_count, delay_ms, trace, headers, body and rendered_html of where each ends."""
    answers = responses.select(F.col("url").alias("_url"), F.col("visit_no").alias("_visit"), *[c for c in responses.columns if c not in ("url", "visit_no")])
    last = responses.groupBy(F.col("url").alias("_u")).agg(F.max("visit_no").alias("_last"))
    going = requests.select("request_id", "url", F.col("url").alias("current")).withColumns({
        "seen": F.array("url"), "chain": F.array("url"), "visits": F.array("url"), "hops": F.lit(0), "retries": F.lit(max_retries), "request_count": F.lit(0),
        "attempt_count": F.lit(1), "delay_ms": F.lit(0).cast("double"), "trace": F.array().cast(EVENT)})
    ended: list[DataFrame] = []
    for _ in range((max_redirects + 2) * (max_retries + 1)):
        visit = F.size(F.filter("visits", lambda v: v == F.col("current")))
        at = going.join(last, F.col("current") == F.col("_u"), "left").withColumn("_want", F.least(visit, F.col("_last")))
        at = at.join(answers, (F.col("current") == F.col("_url")) & (F.col("_want") == F.col("_visit")), "left").drop("_u", "_last", "_want", "_url", "_visit")
        at = at.withColumn("request_count", F.col("request_count") + 1).withColumn("error_name", F.when(F.col("status").isNull(), F.coalesce("error_name", F.lit("NoResponse"))).otherwise(F.col("error_name")))
        at = at.withColumn("next", F.when(F.col("status").between(300, 399), resolve_url("current", F.coalesce(header("location"), F.lit("")))))
        at = materialise(at, "transport_step")
        redirect, retry = F.col("status").between(300, 399), (F.col("status") == 503) & (F.col("retries") > 0)
        reason = (
            F.when(F.col("error_name").isin("HeadersTimeoutError", "BodyTimeoutError"), "timeout").when(F.col("error_name").isNotNull(), "connection_error")
            .when(redirect & F.col("next").isNull(), "http_error").when(redirect & ~F.lower("next").rlike("^https?:"), "policy_denied")
            .when(redirect & F.array_contains("seen", F.col("next")), "redirect_loop").when(redirect & (F.col("hops") >= max_redirects), "redirect_limit")
        )
        step = at.withColumn("failure_reason", reason)
        event = F.when(F.col("error_name").isNotNull(), "request_failed").otherwise("request_complete")
        more = F.when(F.col("failure_reason").isin("redirect_loop", "redirect_limit"), F.col("failure_reason")).when(F.col("failure_reason") == "policy_denied", F.lit("redirect_policy_denied")).when(redirect & F.col("failure_reason").isNull(), F.lit("redirect")).when(retry, F.lit("retry"))
        events = F.array(F.struct(event.alias("event"), F.col("current").alias("url"), "status", F.coalesce("failure_reason", "error_name").alias("detail")), F.struct(more.alias("event"), F.col("current").alias("url"), "status", F.col("next").alias("detail")))
        step = step.withColumn("trace", F.concat("trace", F.filter(events, lambda e: e["event"].isNotNull()).cast(EVENT)))
        follow, again = redirect & F.col("failure_reason").isNull(), F.col("error_name").isNull() & retry
        ended.append(step.filter(~(follow | again)))
        delay = F.least(F.coalesce(retry_after_ms(header("retry-after")), F.lit(0.0)), F.lit(float(cap_ms)))
        target = F.when(follow, F.col("next")).otherwise(F.col("current"))
        going = step.filter(follow | again).select(
            "request_id", "url", target.alias("current"), F.when(follow, F.array_append("seen", F.col("next"))).otherwise(F.array("current")).alias("seen"),
            F.when(follow, F.array_append("chain", F.col("next"))).otherwise(F.col("chain")).alias("chain"), F.array_append("visits", target).alias("visits"),
            F.when(follow, F.col("hops") + 1).otherwise(0).alias("hops"), F.when(follow, F.col("retries")).otherwise(F.col("retries") - 1).alias("retries"), "request_count",
            F.when(follow, F.col("attempt_count")).otherwise(F.col("attempt_count") + 1).alias("attempt_count"), (F.col("delay_ms") + F.when(again, delay).otherwise(0.0)).alias("delay_ms"), "trace")
        if going.isEmpty():
            break
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    final = F.when(F.col("failure_reason") == "redirect_loop", F.col("next")).otherwise(F.col("current"))
    return out.withColumns({"kind": F.when(F.col("failure_reason").isNull(), "ok").otherwise("failure"), "final_url": final, "redirect_chain": F.col("chain")}).drop("seen", "chain", "visits", "hops", "retries", "next", "current")


def assemble_bodies(chunks: DataFrame, cap: int) -> DataFrame:
    """chunks(request_id, seq, data, is_last) as one row for each request: body, n_chunks, size in bytes, and status.

    A body is read up to its cap: the chunk that passes it ends the reading (too_large), so an endless body costs the cap and
    not what follows. Without its last chunk a body is incomplete; a gap in the numbers, from 0, ends it too."""
    order = Window.partitionBy("request_id").orderBy("seq")
    rows = chunks.withColumns({"_upto": F.sum(F.octet_length("data")).over(order), "_place": F.row_number().over(order) - 1})
    kept = rows.filter((F.col("_upto") <= cap) & (F.col("seq") == F.col("_place")))
    over = rows.filter((F.col("_upto") > cap) & (F.col("seq") == F.col("_place"))).select("request_id").distinct().withColumn("_over", F.lit(True))
    part = F.array_sort(F.collect_list(F.struct("seq", "data")))
    whole = kept.groupBy("request_id").agg(F.array_join(F.transform(part, lambda c: c["data"]), "").alias("body"), F.count("*").alias("n_chunks"), F.max("_upto").alias("size"), F.bool_or("is_last").alias("_ended"))
    out = chunks.select("request_id").distinct().join(whole, "request_id", "left").join(over, "request_id", "left")
    status = F.when(F.col("_over"), "too_large").when(F.col("_ended"), "complete").otherwise("incomplete")
    return out.select("request_id", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), status.alias("status"))


def route_paths(requests: DataFrame, exact: DataFrame, prefixes: DataFrame, default: Column) -> DataFrame:
    """requests(path) with answer: of the exact route, else of the longest prefix route, else the default.

    The route tables are configuration: two small dimensions."""
    hit = requests.join(F.broadcast(exact.select(F.col("path").alias("_exact"), F.col("answer").alias("_e"))), F.col("path") == F.col("_exact"), "left")
    every = prefixes.agg(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix", "answer")).alias("_prefixes"))  # one row
    near = F.array_max(F.filter("_prefixes", lambda p: F.startswith(F.col("path"), p["prefix"])))["answer"]
    return hit.crossJoin(F.broadcast(every)).select(*requests.columns, F.coalesce("_e", near, default).alias("answer"))


def path_of(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1))
