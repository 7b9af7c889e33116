"""Planned decisions as expressions: escalation, retry by failure class, cost, network policy, link clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import local_rows
from .verdict import CONTENTFUL, PUBLIC_LANES

# What each class of failure does next, and the caps of the network policy.
RETRY_POLICY = [("timeout", "backoff"), ("connection_error", "backoff"), ("blocked", "change_lane"), ("empty_unverified", "escalate"), ("http_error", "never"), ("policy_denied", "never"), ("redirect_loop", "never"), ("redirect_limit", "never")]
MAX_BODY, MAX_DECOMPRESSED, HOST_DELAY_MS, HOST_CONCURRENCY = 10_000_000, 50_000_000, 250, 2
STATUSES = "success partial empty_verified blocked failed cancelled budget_exceeded".split()
# IPv6 by their first bits: the pattern of an expanded address's first group, or a whole address.
PRIVATE_6 = [("^f[cd]", "private"), ("^fe[89ab]", "link_local"), ("^ff", "multicast")]
PRIVATE = [("127.0.0.0", 8, "loopback"), ("10.0.0.0", 8, "private"), ("172.16.0.0", 12, "private"), ("192.168.0.0", 16, "private"), ("169.254.169.254", 32, "metadata"), ("169.254.0.0", 16, "link_local"), ("0.0.0.0", 8, "unspecified")]


def escalation_trigger(page: Column, tokens: Column) -> Column:
    """Why a page should be fetched again by a browser; null if it needn't."""
    html = F.lower(page)
    return (
        F.when(html.rlike(r'<div[^>]*id="(root|app|__next)"[^>]*>\s*</div>'), "spa_fingerprint").when(F.contains(html, F.lit("<noscript")) & (tokens < 50), "noscript_marker").when(tokens < 20, "low_token_yield")
    )


def retry_decision(failures: DataFrame) -> DataFrame:
    """failures(failure_reason, ...) with action, from a dimension of fixed size."""
    policy = local_rows(failures.sparkSession, RETRY_POLICY, "failure_reason string, action string")
    return failures.join(F.broadcast(policy), "failure_reason", "left").withColumn("action", F.coalesce("action", F.lit("never")))


def cost_per_success(outcomes: DataFrame, cost: str = "external_cost_usd", by: str = "subject_id") -> DataFrame:
    return outcomes.groupBy(by).agg(F.sum(cost).alias("cost"), (F.sum(cost) / F.nullif(F.count_if(F.col("status").isin(CONTENTFUL)), F.lit(0))).alias("cost_per_success"))


def improvements(escalations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """escalations(case_id, to_lane) with improved: whether the lane it went to has content where the first had none."""
    got = outcomes.groupBy("case_id", "lane").agg(F.bool_or(F.col("status").isin(CONTENTFUL)).alias("improved"))
    return escalations.drop("improved").join(got.withColumnRenamed("lane", "to_lane"), ["case_id", "to_lane"], "left")


def ipv4(address: Column) -> Column:
    parts = F.transform(F.split(address, r"\."), lambda p: p.try_cast("long"))
    return F.when(address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def plain_address(address: Column) -> Column:
    """The address lower-case, without brackets and zone; an IPv6 address that holds an IPv4 one (::ffff:a.b.c.d or in hexadecimal) as that."""
    a = F.regexp_replace(F.lower(F.trim(address)), r"^\[|\]$|%.*$", "")
    dotted = F.regexp_extract(a, r"^(?:0{0,4}:){2,6}(?:ffff:)?(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    pairs = [F.conv(F.regexp_extract(a, r"^(?:0{0,4}:){2,6}ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 16, 10).cast("int") for k in (1, 2)]
    parts = [F.floor(pairs[0] / 256), pairs[0] % 256, F.floor(pairs[1] / 256), pairs[1] % 256]
    return F.when(dotted != "", dotted).when(a.rlike(r"^(?:0{0,4}:){2,6}ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), F.concat_ws(".", *[p.cast("string") for p in parts])).otherwise(a)


def policy_violation(url: Column, address: Column) -> Column:
    """Why the network policy forbids a request to the resolved address, of either version; null if it may go."""
    address = plain_address(address)
    n = ipv4(address)
    out = F.when(~F.lower(url).rlike(r"^[a-z][a-z0-9+.-]*://[^/]+"), "malformed_url").when(~F.lower(url).rlike("^https?://"), "unsupported_scheme")
    for net, bits, name in PRIVATE:
        base = sum(int(p) << s for p, s in zip(net.split("."), (24, 16, 8, 0), strict=True))
        out = out.when(F.shiftright(n, 32 - bits) == (base >> (32 - bits)), f"{name}_address")
    six = F.contains(address, F.lit(":"))
    out = out.when(six & address.rlike(r"^(?:0{0,4}:)+0{0,4}$"), "unspecified_address").when(six & address.rlike(r"^(?:0{0,4}:)+0{0,3}1$"), "loopback_address")
    for pattern, name in PRIVATE_6:
        out = out.when(six & address.rlike(pattern), f"{name}_address")
    return out


def size_violation(wire: Column, decompressed: Column) -> Column:
    return F.when(wire > MAX_BODY, "body_too_large").when(decompressed > MAX_DECOMPRESSED, "decompressed_too_large")


def is_public_lane(lane: Column) -> Column:
    return lane.isin(PUBLIC_LANES)


def invalid_rows(results: DataFrame) -> DataFrame:
    """Rows whose status isn't one of the known ones; for validation before a write."""
    return results.filter(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)))
