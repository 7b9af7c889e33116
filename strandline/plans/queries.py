"""The engine's queries over the tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, is_cjk, looks_prose, squeeze, strip, upper_median, utf16_length
from ..operators import golden, intervals, pages, policy, robots, score, transport, verdict, windows
from ..session import local_rows, scratch_dir, shipped
from ..sources import fixtures
from ..sources.environment import run_environment
from ..streaming import events as streaming
from . import benchmark, cases, fixture_sql, page_sql
from .outcome_sql import ARMS, OUTCOMES_SQL, document_outcomes, sql_median, sql_tokens
from .page_sql import EXTRA_PAGES, C, W

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = shipped(f)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, and a few that reach the rules which they don't."""
    return table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(local_rows(spark, EXTRA_PAGES, "page_id long, url string, html string"))


NO_ERROR = "CAST(NULL AS VARCHAR) AS error"


EXTRA = ["naïve café x", "漢字かな交じり文。テスト", "한국어 텍스트", "emoji 😀😀 here!", "", "﻿  padded　 ", "Mixed 漢字 and words of latin letters"]
EXTRA_SQL = " UNION ALL ".join(f"SELECT -{i + 1}, '{t}', 'xx'" for i, t in enumerate(EXTRA))
TEXTS_SQL = f"texts(doc_id, text, lang) AS (SELECT doc_id, text, lang FROM documents UNION ALL {EXTRA_SQL})"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and a few rows with the characters that they lack."""
    extra = local_rows(spark, [(-i - 1, t, "xx") for i, t in enumerate(EXTRA)], "doc_id long, text string, lang string")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang").unionByName(extra)


@query(f"WITH {TEXTS_SQL} SELECT doc_id, {sql_tokens('text')} AS tokens FROM texts")
def token_estimate(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {TEXTS_SQL}, t AS (SELECT lang, {sql_tokens('text')} AS tokens FROM texts) SELECT lang, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS total_tokens, {sql_median('tokens')} AS median_tokens, {sql_median('tokens', 0.95)} AS p95_tokens FROM t GROUP BY lang")
def token_estimate_by_lang(spark, sf_dir):
    t = texts(spark, sf_dir).select("lang", estimate_tokens(F.col("text")).alias("tokens"))
    return t.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("tokens").alias("total_tokens"), upper_median("tokens").alias("median_tokens"), upper_median("tokens", 0.95).alias("p95_tokens"))


SQL_CJK = f"(length(regexp_replace(text, '[^{C}]', '', 'g')) > 0 AND length(regexp_replace(text, '[^{C}]', '', 'g')) > 0.3 * (length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))))"


@query(f"WITH {TEXTS_SQL} SELECT doc_id, {SQL_CJK} AS is_cjk, length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS utf16_units FROM texts")
def is_cjk_flag(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", is_cjk(F.col("text")).alias("is_cjk"), utf16_length(F.col("text")).cast("long").alias("utf16_units"))


@query(f"""WITH {TEXTS_SQL} SELECT doc_id, {SQL_CJK} OR regexp_matches(regexp_replace(text, '^[{W}]+|[{W}]+$', '', 'g'), '[.!?;:]["'')\\]]?[{W}]|[.!?]$') AS prose FROM texts""")
def prose_flag(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", looks_prose(F.col("text")).alias("prose"))


@query(f"WITH {TEXTS_SQL} SELECT doc_id, trim(regexp_replace(text, '[{W}]+', ' ', 'g')) AS squeezed FROM texts")
def whitespace_normalise(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", squeeze(F.col("text")).alias("squeezed"))


@query(f"SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^[{W}]+|[{W}]+$', '', 'g') AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strip(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


def sql_golden(html: str) -> str:
    out = f"CASE WHEN regexp_matches({html}, '(?is)<main\\b.*?</main>') THEN regexp_extract({html}, '(?is)<main\\b.*?</main>') WHEN regexp_matches({html}, '(?is)<article\\b.*?</article>') THEN regexp_extract({html}, '(?is)<article\\b.*?</article>') ELSE regexp_replace(regexp_replace({html}, '(?is)<div[^>]*id=\"cookie-consent\".*?</div>', '', 'g'), '(?is)<(?:nav|aside|footer)\\b.*?</(?:nav|aside|footer)>', '', 'g') END"
    for level in range(1, 7):
        out = f"regexp_replace({out}, '(?is)<h{level}\\b[^>]*>(.*?)</h{level}>', chr(10) || '{'#' * level} \\1' || chr(10), 'g')"
    out = f"regexp_replace({out}, '(?is)<li\\b[^>]*>(.*?)</li>', chr(10) || '- \\1', 'g')"
    out = f"regexp_replace({out}, '(?is)<p\\b[^>]*>(.*?)</p>', chr(10) || '\\1' || chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', '', 'g')"
    return f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{W}]+|[{W}]+$', '', 'g')"


@query(f"SELECT page_id, {sql_golden('html')} AS markdown FROM pages")
def golden_extract(spark, sf_dir):
    return golden.with_markdown(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "markdown")


SQL_CHALLENGED = " OR ".join(f"contains(md, '{m}')" for m in verdict.CHALLENGES)


@query(f"""WITH g AS (SELECT regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/([^/?#]*)', 1) AS segment, {sql_golden('html')} AS md FROM pages),
t AS (SELECT segment, md, {sql_tokens('md')} AS tokens, ({SQL_CHALLENGED}) AS challenged FROM g)
SELECT segment, count(*) AS n_pages, count(CASE WHEN md <> '' AND NOT challenged THEN 1 END) AS contentful, {sql_median('tokens')} AS median_tokens FROM t GROUP BY segment""")
def golden_yield_score(spark, sf_dir):
    """By first path segment: pages, pages with content, and the median size of their main content."""
    g = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*/([^/?#]*)", 1).alias("segment"), "html")
    g = golden.with_markdown(g, out="md").withColumn("tokens", estimate_tokens(F.col("md")))
    return g.groupBy("segment").agg(F.count("*").alias("n_pages"), F.count_if((F.col("md") != "") & ~verdict.challenged(F.col("md"))).alias("contentful"), upper_median("tokens").alias("median_tokens"))


@query(page_sql.nodes() + " SELECT b.page_id, CAST(b.node_id AS INTEGER) AS node_id, count(n.node_id) AS n FROM nodes b LEFT JOIN nodes n ON n.page_id = b.page_id AND n.tag IN ('a', 'li') AND n.node_id > b.node_id AND n.node_id <= b.last_id WHERE b.tag IN ('body', 'nav', 'div') GROUP BY ALL")
def page_tag_counts(spark, sf_dir):
    """Links and items below the body and each box, by an interval join."""
    n = pages.html_nodes(page_rows(spark, sf_dir))
    return intervals.descendant_counts(n.filter(F.col("tag").isin("body", "nav", "div")), n, ["a", "li"])


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][\w+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^([a-zA-Z][\w+.-]*://[^/?#]*)', 1)) AS origin,
CASE WHEN regexp_extract(url, '^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)', 1) END AS path FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(u, r"^([a-zA-Z][\w+.-]*)://", 1)).alias("scheme"), transport.origin_of(u).alias("origin"), transport.path_of(u).alias("path"))


RULES = [("/en", False), ("/en/1*", True), ("/*5$", False), ("/fr/", False), ("/fr/*2", True), ("/%_x", False), ("/de*/", True), ("/de", False), ("*?", False)]
RULES_SQL = "rules(pattern, allow) AS (VALUES " + ", ".join(f"('{p}', {str(a).lower()})" for p, a in RULES) + ")"
LIKE_SQL = r"regexp_replace(regexp_replace(regexp_replace(pattern, '\$$', ''), '([\\%_])', '\\\1', 'g'), '\*+', '%', 'g') || CASE WHEN suffix(pattern, '$') THEN '' ELSE '%' END"


@query(rf"""WITH {RULES_SQL}, c AS (SELECT pattern, allow, {LIKE_SQL} AS p FROM rules),
u AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, path, coalesce(arg_max(allow, length(pattern) * 2 + allow::INT), true) AS allowed FROM u LEFT JOIN c ON path LIKE p ESCAPE '\' GROUP BY page_id, path""")
def robots_allowed(spark, sf_dir):
    rules = local_rows(spark, [("*", p, a) for p, a in RULES], "host string, pattern string, allow boolean")
    paths = table(spark, sf_dir, "pages").select("page_id", F.lit("*").alias("host"), F.regexp_extract("url", r"^[a-zA-Z]+://[^/]*([^#]*)", 1).alias("path"))
    return robots.is_allowed(paths, rules).drop("host")


EDGES = [("/a", "/b"), ("/b", "/c"), ("/c", None), ("/l1", "/l2"), ("/l2", "/l1"), *[(f"/h{i}", f"/h{i + 1}") for i in range(8)], ("/h8", None), ("/s", "/s"), ("/f", "ftp://x.test/y")]
SITE = "http://t.test"


@query("WITH RECURSIVE e(u, v) AS (VALUES " + ", ".join(f"('{SITE}{u}', {'NULL' if v is None else repr(v if '://' in v else SITE + v)})" for u, v in EDGES) + """),
r AS (SELECT u AS start, u AS cur, [u] AS seen, 0 AS hops, 1 AS requests, NULL::VARCHAR AS reason, false AS done FROM e
 UNION ALL SELECT r.start, CASE WHEN e.v IS NULL OR NOT starts_with(e.v, 'http') THEN r.cur WHEN list_contains(r.seen, e.v) THEN e.v WHEN r.hops >= 5 THEN r.cur ELSE e.v END,
  CASE WHEN e.v IS NULL THEN r.seen ELSE list_append(r.seen, e.v) END, r.hops + 1, r.requests + CASE WHEN e.v IS NULL OR NOT starts_with(e.v, 'http') OR list_contains(r.seen, e.v) OR r.hops >= 5 THEN 0 ELSE 1 END,
  CASE WHEN e.v IS NULL THEN NULL WHEN NOT starts_with(e.v, 'http') THEN 'policy_denied' WHEN list_contains(r.seen, e.v) THEN 'redirect_loop' WHEN r.hops >= 5 THEN 'redirect_limit' END,
  e.v IS NULL OR NOT starts_with(e.v, 'http') OR list_contains(r.seen, e.v) OR r.hops >= 5
 FROM r JOIN e ON e.u = r.cur WHERE NOT r.done)
SELECT start AS url, cur AS final_url, reason AS failure_reason, CAST(requests AS INTEGER) AS request_count FROM r WHERE done""")
def redirect_resolve(spark, sf_dir):
    rows = [(SITE + u, 1, 200 if v is None else 302, {} if v is None else {"location": v}, "", None, None, 0, 0, 0) for u, v in EDGES]
    responses = spark.createDataFrame(rows, transport.RESPONSES)
    requests = responses.select(F.col("url").alias("request_id"), "url")
    return transport.resolve(requests, responses).select("url", "final_url", "failure_reason", "request_count")


VALUES = ["", " ", "0", "2", "1.5", "-1", "abc", "9999", " 7 ", "1e2", None, "0x10", " 0B101 ", "0o17", "0xg", "Infinity"]


@query("WITH v(id, value) AS (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else repr(v)})" for i, v in enumerate(VALUES)) + r""")
SELECT id, CASE WHEN value = '' THEN NULL WHEN trim(value) = '' THEN 0.0::DOUBLE WHEN id = 11 THEN 16000 WHEN id = 12 THEN 5000 WHEN id = 13 THEN 15000 WHEN id >= 14 THEN NULL WHEN TRY_CAST(trim(value) AS DOUBLE) >= 0 THEN TRY_CAST(trim(value) AS DOUBLE) * 1000 END AS delay_ms FROM v""")
def retry_after_ms(spark, sf_dir):
    rows = local_rows(spark, list(enumerate(VALUES)), "id int, value string")
    return rows.select("id", transport.retry_after_ms(F.col("value")).alias("delay_ms"))


PATHS, EXACT, PREFIXES = ["/home", "/redirect/chain/3", "/redirect/x", "/duplicate/c", "/nowhere", "/homes"], ["/home", "/duplicate/c"], ["/redirect/", "/redirect/chain/"]


def sql_column(values: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in values) + ")"


@query(f"""WITH p(path) AS {sql_column(PATHS)}, e(path) AS {sql_column(EXACT)}, x(prefix) AS {sql_column(PREFIXES)}
SELECT p.path, coalesce(max('exact ' || e.path), 'prefix ' || arg_max(x.prefix, length(x.prefix)), 'soft404') AS answer FROM p LEFT JOIN e ON p.path = e.path LEFT JOIN x ON starts_with(p.path, x.prefix) GROUP BY p.path""")
def route_fixture(spark, sf_dir):
    one = lambda values, name: local_rows(spark, [(v,) for v in values], f"{name} string")
    exact = one(EXACT, "path").withColumn("answer", F.concat(F.lit("exact "), F.col("path")))
    prefixes = one(PREFIXES, "prefix").withColumn("answer", F.concat(F.lit("prefix "), F.col("prefix")))
    return transport.route_paths(one(PATHS, "path"), exact, prefixes, F.lit("soft404"))


@query(f"WITH t(doc_id, md) AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'x Just a moment y' UNION ALL SELECT -2, 'please wait' UNION ALL SELECT -3, 'Please wait' UNION ALL SELECT -4, NULL) SELECT doc_id, CASE WHEN {SQL_CHALLENGED} THEN 'fail' ELSE 'pass' END AS outcome FROM t")
def challenge_check(spark, sf_dir):
    extra = local_rows(spark, [(-1, "x Just a moment y"), (-2, "please wait"), (-3, "Please wait"), (-4, None)], "doc_id long, text string")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)
    return rows.select("doc_id", verdict.outcome(verdict.challenged(F.col("text"))).alias("outcome"))


@query("SELECT b.item_id, count(*) AS n_docs, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def required_content_check(spark, sf_dir):
    """Documents that contain each benchmark passage, anywhere in a word or between words."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    pairs = windows.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), items, "doc_id", "text", "item_id", "passage")
    return pairs.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def outcomes_of(spark, sf_dir):
    return document_outcomes(table(spark, sf_dir, "documents"))


@query(OUTCOMES_SQL + ' SELECT doc_id, "check", outcome FROM k')
def content_checks(spark, sf_dir):
    """The five checks of each document as an arm's result."""
    return outcomes_of(spark, sf_dir).select("doc_id", F.explode("checks").alias("c")).select("doc_id", "c.check", "c.outcome")


@query(OUTCOMES_SQL + """ SELECT doc_id, status, status = 'success' AS status_matched, lane = 'http' AS lane_matched, is_false_success, budget_respected,
 (SELECT string_agg("check", ',' ORDER BY "check") FROM k WHERE k.doc_id = o.doc_id AND outcome <> 'unknown') AS evaluated FROM o""")
def case_outcomes(spark, sf_dir):
    evaluated = F.array_join(F.array_sort("evaluated_checks"), ",").alias("evaluated")
    return outcomes_of(spark, sf_dir).select("doc_id", "status", "status_matched", "lane_matched", "is_false_success", "budget_respected", evaluated)


@query(OUTCOMES_SQL + " SELECT doc_id, wall_ms, CASE WHEN late THEN 'time' END AS budget_exceeded, md = '' AS no_content FROM o")
def case_timeout(spark, sf_dir):
    return outcomes_of(spark, sf_dir).select("doc_id", "wall_ms", "budget_exceeded", (F.coalesce("markdown", F.lit("")) == "").alias("no_content"))


@query(OUTCOMES_SQL + " SELECT doc_id, outcome FROM k WHERE \"check\" = 'content_yield_below_floor'")
def yield_floor_check(spark, sf_dir):
    return outcomes_of(spark, sf_dir).select("doc_id", F.explode("checks").alias("c")).filter(F.col("c.check") == "content_yield_below_floor").select("doc_id", "c.outcome")


@query(OUTCOMES_SQL + f""" SELECT subject_id, count(*) AS case_count, count(*) FILTER (status = 'success') AS status_match_count, count(*) FILTER (contentful) AS contentful_count, count(*) FILTER (is_false_success) AS false_success_count,
count(*) FILTER (is_false_success) / nullif(count(*) FILTER (contentful), 0) AS false_success_rate, {sql_median('wall_ms')} AS median_wall_ms, {sql_median('wall_ms', 0.95)} AS p95_wall_ms, {sql_median('content_tokens')} AS median_content_tokens,
count(*) FILTER (NOT budget_respected) AS budget_violations FROM o GROUP BY subject_id""")
def false_success_rollup(spark, sf_dir):
    return score.suite_scores(outcomes_of(spark, sf_dir))


@query(OUTCOMES_SQL + " SELECT subject_id, lane, count(*) AS n FROM o GROUP BY ALL")
def lane_distribution(spark, sf_dir):
    return score.lane_distribution(outcomes_of(spark, sf_dir))


TALLY = ", ".join(f"count(*) FILTER (outcome = '{x}') AS {x}" for x in ("pass", "fail", "unknown"))


@query(OUTCOMES_SQL + f' SELECT subject_id, "check", {TALLY} FROM k GROUP BY ALL')
def check_tallies(spark, sf_dir):
    return score.check_tallies(outcomes_of(spark, sf_dir))


@query(OUTCOMES_SQL + f" SELECT subject_id, {TALLY} FROM k WHERE \"check\" = 'challenge_text_returned' GROUP BY ALL")
def challenge_tally(spark, sf_dir):
    return score.challenge_tally(outcomes_of(spark, sf_dir))


def sql_tiers(rows: str) -> str:
    return f"""SELECT subject_id, tier, count(*) AS cases, count(*) FILTER (contentful) AS contentful, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'failed') AS failed,
count(*) FILTER (NOT budget_respected) AS budget_misses, {sql_median('content_tokens')} AS median_tokens, (SELECT {sql_median('x.wall_ms')} FROM {rows} x WHERE x.subject_id = t.subject_id) AS median_wall_ms FROM {rows} t GROUP BY subject_id, tier"""


@query(OUTCOMES_SQL + ", t AS (SELECT *, CASE WHEN starts_with(case_id, 'canary2-') THEN 2 ELSE 1 END AS tier FROM o) " + sql_tiers("t"))
def arm_tier_report(spark, sf_dir):
    """Tiers of each arm; the median time is the arm's over both."""
    return score.tier_report(outcomes_of(spark, sf_dir))


BRIEF = "CASE WHEN contentful THEN 'ok (' || coalesce(content_tokens::VARCHAR, '0') || ' tok)' WHEN status = 'blocked' THEN 'blocked (rate_limit)' WHEN status = 'budget_exceeded' THEN 'budget' ELSE 'failed (http_error)' END"


@query(OUTCOMES_SQL + " SELECT case_id, " + ", ".join(f"max({BRIEF}) FILTER (subject_id = '{a}') AS {a}" for a in ARMS) + " FROM o GROUP BY case_id")
def case_arm_pivot(spark, sf_dir):
    return score.case_by_arm(outcomes_of(spark, sf_dir), ARMS)


@query(OUTCOMES_SQL + """ SELECT subject_id || ': ' || count(*) || ' cases, ' || count(*) FILTER (status = 'success') || ' status matches, ' || count(*) FILTER (contentful) || ' contentful, ' || count(*) FILTER (is_false_success) || ' false successes (' ||
coalesce(printf('%.1f%%', 100 * count(*) FILTER (is_false_success) / nullif(count(*) FILTER (contentful), 0)), 'N/A') || '), median ' || """ + sql_median("wall_ms") + """ || ' ms, ' || count(*) FILTER (NOT budget_respected) || ' over budget' AS line FROM o GROUP BY subject_id""")
def console_report(spark, sf_dir):
    return local_rows(spark, [(x,) for x in benchmark.console_lines(outcomes_of(spark, sf_dir))], "line string")


@query(f"SELECT event_type, count(*) AS n, {sql_median('value')} AS median_value, {sql_median('value', 0.95)} AS p95_value FROM events GROUP BY event_type")
def wall_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), upper_median("value", kind="double").alias("median_value"), upper_median("value", 0.95, "double").alias("p95_value"))


@query("""WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a),
c AS (SELECT user_id, run, min(event_type) AS event_type, count(*) AS run_length, min(event_id) AS run_start FROM b GROUP BY user_id, run)
SELECT user_id, event_type, run_length, run_start FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run_length DESC, run) = 1""")
def longest_run(spark, sf_dir):
    return windows.longest_run(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT event_id, user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS attempt FROM events")
def attempt_number(spark, sf_dir):
    return windows.attempt_number(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, user_id, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000) AS BIGINT) AS elapsed_ms FROM events")
def trace_elapsed(spark, sf_dir):
    return windows.trace_elapsed(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts").drop("ts")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY cents DESC, o_orderkey) AS k FROM s)
SELECT a.o_custkey, a.o_orderkey AS best, a.cents AS best_score, b.o_orderkey AS runner_up, b.cents AS runner_up_score, coalesce(b.cents, 0) = 0 OR a.cents >= b.cents * 1.4::DOUBLE AS dominates
FROM r a LEFT JOIN r b ON a.o_custkey = b.o_custkey AND b.k = 2 WHERE a.k = 1""")
def best_and_runner_up(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return windows.best_and_runner_up(rows, "o_custkey", "o_orderkey", "cents")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, min(doc_id) OVER w AS first_key, count(*) OVER w AS copies, doc_id = min(doc_id) OVER w AS is_first FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))")
def content_hash_dedupe(spark, sf_dir):
    return windows.content_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT 'd' || doc_id AS id, 'documents' AS platform, length(text) AS n FROM documents UNION ALL SELECT 'b' || item_id, 'benchmark', length(text) FROM benchmark""")
def ledger_union(spark, sf_dir):
    from ..sources.ledger import union_ledgers

    one = lambda name, letter, key: table(spark, sf_dir, name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.lit(name).alias("platform"), F.length("text").cast("long").alias("n"))
    return union_ledgers(one("documents", "d", "doc_id"), one("benchmark", "b", "item_id"))


def canaries(spark, sf_dir):
    """Stored pages as canary cases, each under a URL of its own."""
    p = table(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))
    return fixtures.canary_truths(p), fixtures.page_responses(p)


def sql_canary(arm: str, rows: str, tokens: str, ok: str = "true") -> str:
    return f"""SELECT '{arm}' AS subject_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS tier, CASE WHEN page_id % 2 = 0 THEN 'canary-' ELSE 'canary2-' END || page_id AS case_id, {ok} AS contentful,
CASE WHEN {ok} THEN 'success' ELSE 'failed' END AS status, CASE WHEN {ok} THEN {tokens} END AS content_tokens, 0::BIGINT AS wall_ms, CASE WHEN {ok} THEN {tokens} <= 4000 ELSE true END AS budget_respected FROM {rows}"""


@query(f"WITH t AS ({sql_canary('bare-http', 'pages', sql_tokens('html'))} UNION ALL {sql_canary('golden-converter', '(SELECT page_id, ' + sql_golden('html') + ' AS md FROM pages)', sql_tokens('md'))}) SELECT subject_id, case_id, status, content_tokens, budget_respected FROM t")
def arm_case_cross(spark, sf_dir):
    """Two arms over all stored pages: a result for each pair of arm and case."""
    return benchmark.run_arms(*canaries(spark, sf_dir), ["bare-http", "golden-converter"]).select("subject_id", "case_id", "status", "content_tokens", "budget_respected")


@query(r"""WITH u AS (SELECT page_id, url, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)='))) AS q FROM pages)
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^([a-zA-Z][\w+.-]*://[^/?#]*)', 1)), '^(http://[^/]*):80$', '\1'), '^(https://[^/]*):443$', '\1')
|| coalesce(nullif(regexp_extract(url, '^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS normalised FROM u""")
def url_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", windows.normalised_url(F.col("url")).alias("normalised"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
t AS (SELECT *, {sql_tokens('part')} AS tokens FROM l),
c AS (SELECT *, CAST(floor(coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 256) AS INTEGER) AS chunk FROM t)
SELECT doc_id, chunk, CAST(min(line) AS INTEGER) AS first_line, CAST(max(line) AS INTEGER) AS last_line, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS lines FROM c GROUP BY doc_id, chunk""")
def line_chunks(spark, sf_dir):
    """Lines packed by running token count; headings aren't looked at, and nothing overlaps."""
    return windows.paragraph_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 256)


@query(f"""WITH {TEXTS_SQL.replace("texts(doc_id, text, lang) AS (", "sample_(doc_id, text, lang) AS (")}, texts AS (SELECT doc_id, text FROM sample_ UNION ALL SELECT -100, repeat('漢字かな', 250) UNION ALL SELECT -101, repeat('ab 漢😀', 300)),
p AS (SELECT doc_id, text, unnest(range(1, least(length(text), 1024) + 1)) AS i FROM texts),
c AS (SELECT doc_id, i, substring(text, i, 1) AS ch FROM p),
u AS (SELECT doc_id, i, sum(CASE WHEN regexp_matches(ch, '[{C}]') THEN 1 ELSE 0 END) OVER w AS cjk, sum(CASE WHEN regexp_matches(ch, '[{C}]') THEN 0 WHEN unicode(ch) > 65535 THEN 2 ELSE 1 END) OVER w AS other FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, max(i) AS fits FROM u WHERE ceil(other / 4) + cjk <= 256 GROUP BY doc_id)
SELECT doc_id, CASE WHEN fits < length(text) THEN left(text, fits) ELSE text END AS kept, coalesce(fits < length(text), false) AS truncated, CASE WHEN fits < length(text) THEN fits END AS truncated_at FROM texts LEFT JOIN f USING (doc_id)""")
def token_truncation(spark, sf_dir):
    more = local_rows(spark, [(-100, "漢字かな" * 250, "xx"), (-101, "ab 漢😀" * 300, "xx")], "doc_id long, text string, lang string")
    rows = texts(spark, sf_dir).unionByName(more)
    cut = rows.select("doc_id", windows.truncate_to_tokens(F.col("text"), 256).alias("t"))
    return cut.select("doc_id", F.col("t.text").alias("kept"), "t.truncated", F.col("t.truncated_at").cast("long").alias("truncated_at"))


SECTIONS = ["# One\nalpha beta gamma delta\n## Two\nshort\n```\n# not a heading\n```\nlast of it", "no heading\nat all", "## A\n### B\ntext under b\n## C\n# D\n#nospace\ntext under d", "# Long\n" + "\n".join(f"line {i} of a long section of the text" for i in range(30))]


@query(f"""WITH t(doc_id, text) AS (SELECT doc_id, text FROM documents UNION ALL VALUES {", ".join("({}, '{}')".format(-i - 1, x.replace("'", "''")) for i, x in enumerate(SECTIONS))}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS line FROM t),
a AS (SELECT *, {sql_tokens('part')} AS tokens, sum(CASE WHEN regexp_matches(part, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) % 2 AS fenced FROM l),
h AS (SELECT *, CASE WHEN fenced = 0 AND regexp_matches(part, '^#{{1,6}} ') THEN length(regexp_extract(part, '^#+')) END AS level FROM a),
s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM h),
b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY doc_id, section ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM s),
c AS (SELECT doc_id, section, CAST(floor(upto / 64) AS BIGINT) AS part_no, min(line) AS f, max(line) AS t, min(upto) AS begun FROM b GROUP BY ALL),
x AS (SELECT c.*, coalesce((SELECT min(y.line) FROM b y WHERE y.doc_id = c.doc_id AND y.section = c.section AND y.line < c.f AND y.upto < c.begun AND y.upto >= c.begun - 16), c.f) AS first_line FROM c),
open AS (SELECT x.doc_id, x.section, x.part_no, string_agg(regexp_replace(g.part, '^#+\\s*', ''), ' > ' ORDER BY g.section) AS path FROM x JOIN s g ON g.doc_id = x.doc_id AND g.level IS NOT NULL AND g.section <= x.section
  WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.doc_id = g.doc_id AND z.section > g.section AND z.section <= x.section AND z.level <= g.level) GROUP BY ALL)
SELECT x.doc_id, CAST(row_number() OVER (PARTITION BY x.doc_id ORDER BY x.section, x.part_no) - 1 AS INTEGER) AS chunk, CAST(x.first_line AS INTEGER) AS first_line, CAST(x.t AS INTEGER) AS last_line, CAST(x.t - x.first_line + 1 AS INTEGER) AS n_lines,
 CAST((SELECT sum(y.tokens) FROM b y WHERE y.doc_id = x.doc_id AND y.line BETWEEN x.first_line AND x.t) AS BIGINT) AS tokens, coalesce(path, '') AS path FROM x LEFT JOIN open USING (doc_id, section, part_no)""")
def heading_chunks(spark, sf_dir):
    """Chunks at headings, of about 64 tokens, each with up to 16 tokens of the lines before it."""
    more = local_rows(spark, [(-i - 1, x) for i, x in enumerate(SECTIONS)], "doc_id long, text string")
    return windows.heading_chunks(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(more), "doc_id", "text", 64, 16)


@query("""WITH p AS (SELECT lang, min(doc_id) AS probe FROM documents GROUP BY lang),
w AS (SELECT doc_id, lang, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS s FROM documents)
SELECT w.doc_id, CASE WHEN len(list_distinct(list_concat(w.s, q.s))) > 0 THEN len(list_intersect(w.s, q.s)) / len(list_distinct(list_concat(w.s, q.s))) ELSE 0.0 END AS similarity
FROM w JOIN p ON w.lang = p.lang JOIN w q ON q.doc_id = p.probe""".replace("\\\\", "\\"))
def soft404_similarity(spark, sf_dir):
    """How alike each document is to its language's first one, as pages are to a site's answer for a page that isn't there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    first = docs.groupBy("lang").agg(F.min("doc_id").alias("doc_id"))
    probes = docs.join(F.broadcast(first), ["lang", "doc_id"]).select("lang", windows.word_set(F.col("text")).alias("probe"))
    return windows.likeness(docs, probes, "lang", "text", "probe").select("doc_id", "similarity")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def trace_window_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return streaming.window_counts(e).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 12 HOUR AND ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM b GROUP BY user_id, s""")
def host_sessions(spark, sf_dir):
    out = streaming.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def event_stream(spark, sf_dir):
    """The events as a stream of files. All come in one batch, so that none is late; tests stream them in parts."""
    path = f"{scratch_dir(spark)}/events-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").write.parquet(path)
    return streaming.event_stream(spark, path, 1_000_000)


def streamed(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives of all that is there."""
    return streaming.run_to_memory(stream, f"q{uuid.uuid4().hex}", mode)


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, max(ts) AS last FROM events GROUP BY user_id)
SELECT user_id, CAST(errors AS INTEGER) AS errors, errors < 3 AS may_retry, CASE WHEN errors > 0 THEN last + to_seconds(60 * pow(2, least(errors, 20) - 1)::BIGINT) ELSE last END AS retry_at FROM u""")
def stream_attempts(spark, sf_dir):
    """Retry state of each user after the stream of events."""
    out = streamed(streaming.attempts(event_stream(spark, sf_dir)), "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("errors", "may_retry", "retry_at"), "retry_at").alias("r")).select("user_id", "r.errors", "r.may_retry", F.col("r.retry_at").cast("timestamp_ntz").alias("retry_at"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a),
c AS (SELECT user_id, max(ts) + INTERVAL 12 HOUR AS deadline, CAST(count(*) AS INTEGER) AS events FROM b GROUP BY user_id, s)
SELECT * FROM c WHERE deadline < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_deadlines(spark, sf_dir):
    """Each time that a user gave no event for twelve hours, as timers find it."""
    out = streamed(streaming.deadlines(event_stream(spark, sf_dir)))
    return out.withColumn("deadline", F.col("deadline").cast("timestamp_ntz"))


@query("SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def stream_first_seen(spark, sf_dir):
    """Of a stream, the first of each user and type: how many types each user has shown."""
    rows = event_stream(spark, sf_dir).withColumn("pair", F.concat_ws("/", "user_id", "event_type"))
    return streamed(streaming.first_seen(rows, "pair").select("user_id", "pair")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS streak FROM r)
SELECT user_id, CAST(arg_max(streak, event_id) AS INTEGER) AS streak, max(streak) >= 3 AS loop_detected FROM s GROUP BY user_id""")
def stream_identical_stop(spark, sf_dir):
    """Users whose stream had three equal events in a row."""
    out = streamed(streaming.identical_stop(event_stream(spark, sf_dir), "user_id", "event_id", "event_type"), "update")
    return out.groupBy("user_id").agg(F.last("streak").alias("streak"), F.bool_or("loop_detected").alias("loop_detected"))


@query("""WITH c AS (SELECT user_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS data, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_id % 3 <> 0),
d AS (SELECT *, CASE WHEN request_id % 5 = 0 AND seq >= 4 THEN seq + 1 ELSE seq END AS place, sum(length(data)) OVER (PARTITION BY request_id ORDER BY seq) AS upto FROM c),
k AS (SELECT * FROM d WHERE place = seq AND upto <= 150),
s AS (SELECT request_id, string_agg(data, '' ORDER BY seq) AS body, count(*) AS n_chunks, CAST(max(upto) AS BIGINT) AS size, bool_or(seq = n - 1) AS ended FROM k GROUP BY request_id),
o AS (SELECT request_id, bool_or(place = seq AND upto > 150) AS over FROM d GROUP BY request_id)
SELECT request_id, coalesce(body, '') AS body, coalesce(n_chunks, 0) AS n_chunks, coalesce(size, 0) AS size, CASE WHEN over THEN 'too_large' WHEN ended THEN 'complete' ELSE 'incomplete' END AS status FROM o LEFT JOIN s USING (request_id)""")
def chunked_bodies(spark, sf_dir):
    """Events as the chunks of bodies, with a gap in some and a cap that others pass."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").filter("event_id % 3 <> 0").select("user_id", "event_id", "event_type")
    e = e.withColumns({"k": F.row_number().over(w.orderBy("event_id")) - 1, "n": F.count("*").over(w)})
    seq = F.when((F.col("user_id") % 5 == 0) & (F.col("k") >= 4), F.col("k") + 1).otherwise(F.col("k"))
    return transport.assemble_bodies(e.select(F.col("user_id").alias("request_id"), seq.alias("seq"), F.col("event_type").alias("data"), (F.col("k") == F.col("n") - 1).alias("is_last")), 150)


@query("SELECT event_type, CASE event_type WHEN 'error' THEN 'http_error' WHEN 'view' THEN 'timeout' WHEN 'click' THEN 'empty_unverified' ELSE 'other' END AS failure_reason, CASE event_type WHEN 'view' THEN 'backoff' WHEN 'click' THEN 'escalate' ELSE 'never' END AS action, count(*) AS n FROM events GROUP BY 1, 2, 3")
def retry_policy(spark, sf_dir):
    t = F.col("event_type")
    rows = table(spark, sf_dir, "events").withColumn("failure_reason", F.when(t == "error", "http_error").when(t == "view", "timeout").when(t == "click", "empty_unverified").otherwise("other"))
    return policy.retry_decision(rows).groupBy("event_type", "failure_reason", "action").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS streak FROM r)
SELECT user_id, event_id, event_type, CAST(streak AS INTEGER) AS streak, streak >= 3 AS loop_detected FROM s""")
def identical_dom_stop(spark, sf_dir):
    return windows.identical_streak(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost, sum(CAST(round(value * 100) AS BIGINT)) / nullif(count(CASE WHEN user_id % 3 = 0 THEN 1 END), 0) AS cost_per_success FROM events GROUP BY event_type")
def cost_per_success(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), F.when(F.col("user_id") % 3 == 0, "success").otherwise("failed").alias("status"))
    return policy.cost_per_success(rows, "cents", "event_type")


ADDRESSES = ["127.0.0.1", "10.1.2.3", "172.16.0.9", "172.32.0.1", "192.168.1.1", "169.254.169.254", "169.254.1.1", "0.0.0.0", "8.8.8.8"]
#: IPv6 addresses and what each is.
ADDRESSES_6 = {
    "::1": "loopback", "[::1]": "loopback", "0:0:0:0:0:0:0:1": "loopback", "::": "unspecified", "fd12:3456::1": "private", "FC00::1": "private", "fe80::1%eth0": "link_local", "ff02::1": "multicast",
    "::ffff:10.0.0.1": "private", "::ffff:7f00:1": "loopback", "::ffff:8.8.8.8": None, "2606:4700::1111": None, "2001:db8::1": None,
}


@query("WITH a(ip) AS " + sql_column(ADDRESSES) + ", n AS (SELECT ip, list_transform(string_split(ip, '.'), lambda p: CAST(p AS BIGINT)) AS p FROM a) SELECT ip, CASE WHEN p[1] = 127 THEN 'loopback_address' WHEN p[1] = 10 OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31) OR (p[1] = 192 AND p[2] = 168) THEN 'private_address' WHEN ip = '169.254.169.254' THEN 'metadata_address' WHEN p[1] = 169 AND p[2] = 254 THEN 'link_local_address' WHEN p[1] = 0 THEN 'unspecified_address' END AS violation FROM n UNION ALL VALUES " + ", ".join(f"('{a}', {'NULL' if v is None else repr(v + '_address')})" for a, v in ADDRESSES_6.items()))
def network_policy(spark, sf_dir):
    rows = local_rows(spark, [(a,) for a in [*ADDRESSES, *ADDRESSES_6]], "ip string")
    return rows.select("ip", policy.policy_violation(F.lit("http://x.test/"), F.col("ip")).alias("violation"))


@query(page_sql.DOM_NODES + "")
def dom_nodes(spark, sf_dir):
    return pages.html_nodes(page_rows(spark, sf_dir)).drop("attrs", "error")


@query(page_sql.PRUNED_NODES)
def pruned_nodes(spark, sf_dir):
    return pages.pruned_nodes(page_rows(spark, sf_dir)).drop("attrs", "error")


@query(page_sql.PAGE_SIGNALS.replace("SELECT * FROM sig", f"SELECT *, {NO_ERROR} FROM sig"))
def page_signals(spark, sf_dir):
    return pages.page_signals(page_rows(spark, sf_dir))


@query(page_sql.PAGE_ROUTE.replace("FROM routed", f", {NO_ERROR} FROM routed"))
def page_route(spark, sf_dir):
    return pages.page_route(page_rows(spark, sf_dir))


@query(page_sql.TEXT_BLOCKS.replace("link_density FROM b", f"link_density, {NO_ERROR} FROM b"))
def text_blocks(spark, sf_dir):
    return pages.text_blocks(page_rows(spark, sf_dir))


@query(page_sql.EXTRACT_PAGES.replace("SELECT * FROM extracted", f"SELECT *, {NO_ERROR} FROM extracted"))
def extract_pages(spark, sf_dir):
    return pages.extract_pages(page_rows(spark, sf_dir))


@query(page_sql.EXTRACT_PRECISE.replace("SELECT * FROM extracted", f"SELECT *, {NO_ERROR} FROM extracted"))
def extract_precise(spark, sf_dir):
    return pages.extract_pages(page_rows(spark, sf_dir), favor_precision=True)


@query(page_sql.EXTRACT_RECALL.replace("SELECT * FROM extracted", f"SELECT *, {NO_ERROR} FROM extracted"))
def extract_recall(spark, sf_dir):
    return pages.extract_pages(page_rows(spark, sf_dir), favor_recall=True)


@query(page_sql.EXTRACT_PRUNED.replace("SELECT * FROM extracted", f"SELECT *, {NO_ERROR} FROM extracted"))
def extract_pruned(spark, sf_dir):
    """Main content less what a caller's selectors match."""
    return pages.extract_pages(page_rows(spark, sf_dir), prune_selectors=("section", "main > p, div > p"))


@query(page_sql.pruned(False) + page_sql.EXTRACT + f" SELECT page_id, title, page_type, strategy, escalate, {sql_tokens('main_html')} AS tokens FROM extracted")
def main_content(spark, sf_dir):
    """Title, type and size of each stored page's main content, as the extracting arms give it out. (None of these has a table, so the SQL has no table converter.)"""
    found = pages.extract_pages(table(spark, sf_dir, "pages"))
    md = pages.markdown_tables("main_html")
    return found.select("page_id", "title", "page_type", "strategy", "escalate", estimate_tokens(md).alias("tokens"))


SAID = "(SELECT coalesce(string_agg(x.text, '' ORDER BY x.node_id), '') FROM nodes x WHERE x.page_id = n.page_id AND x.kind = 'text' AND x.node_id BETWEEN n.node_id AND n.last_id)"


@query(page_sql.nodes() + f", h AS (SELECT page_id, tag, {SAID} AS said, row_number() OVER (PARTITION BY page_id ORDER BY tag <> 'h1', node_id) AS k FROM nodes n WHERE tag IN ('h1', 'h2', 'h3')) SELECT page_id, tag, trim(said) AS text, {NO_ERROR} FROM h WHERE k = 1")
def minimal_headings(spark, sf_dir):
    return pages.minimal_headings(page_rows(spark, sf_dir))


@query(page_sql.nodes() + f" SELECT page_id, CAST(node_id AS INTEGER) AS node_id, tag, {SAID} AS text FROM nodes n WHERE tag = 'p' AND EXISTS (SELECT 1 FROM nodes u WHERE u.page_id = n.page_id AND u.node_id = n.parent_id AND u.tag = 'article') OR tag = 'div' AND list_contains(string_split(coalesce(class_attr, ''), ' '), 'ad')")
def css_select(spark, sf_dir):
    return pages.selected_nodes(page_rows(spark, sf_dir), "article > p, body div.ad").select("page_id", "node_id", "tag", "text")


@query(fixture_sql.GFM_TABLES)
def gfm_tables(spark, sf_dir):
    rows = fixtures.fixture_responses(spark).filter("body is not null").select(F.col("url").alias("page_id"), F.col("body").alias("html"))
    return pages.gfm_tables(rows).select("page_id", "nth", "gfm")


@query(fixture_sql.TABLE_CHECK)
def expected_table_check(spark, sf_dir):
    """Issues of each annotated table in the table arm's text."""
    t = fixtures.fixture_truths(spark).filter("expected_table is not null").join(fixtures.fixture_responses(spark).select(F.col("url").alias("target"), "body"), "target")
    s = F.col("expected_table")
    issues = pages.expected_table_issues(pages.clamped_tables("body"), s["columns"], s["rows"], s["cells"], s["same_row"], s["same_column"], s["require_markdown"])
    return t.select("case_id", F.array_join(issues, "; ").alias("issues"))


@query(fixture_sql.PLAIN_CASES)
def plain_arm_cases(spark, sf_dir):
    """The plain arm case by case, with what its checks say."""
    out = benchmark.run_arms(fixtures.fixture_truths(spark), fixtures.fixture_responses(spark), ["bare-http"])
    return out.select("case_id", "status", "failure_reason", "content_tokens", "wall_ms", "status_matched", "is_false_success")


@query(fixture_sql.EMITTED)
def emitted_responses(spark, sf_dir):
    """The first answer of each case's target to GET and HEAD."""
    answers = fixtures.fixture_responses(spark)
    asked = fixtures.fixture_truths(spark).select(F.col("target").alias("url"), F.lit(1).alias("visit_no"), F.explode(F.array(F.lit("GET"), F.lit("HEAD"))).alias("method"))
    return fixtures.emitted(asked, answers).select("url", "method", "status", "content_length", F.length("body").cast("long").alias("sent"), "delay_ms")


@query("SELECT 'timeout-body' AS case_id, 'budget_exceeded' AS status, 60000::BIGINT AS wall_ms, 1 AS request_count, true AS empty, 'request_start, timeout (case_timeout_60s)' AS trace")
def timed_out_cases(spark, sf_dir):
    """Cases that the case timer ended in the plain arm, with their trace."""
    out = benchmark.run_arms(fixtures.fixture_truths(spark), fixtures.fixture_responses(spark), ["bare-http"]).filter("budget_exceeded = 'time'")
    said = F.transform("trace", lambda e: F.concat(e["event"], F.coalesce(F.concat(F.lit(" ("), e["detail"], F.lit(")")), F.lit(""))))
    empty = F.col("http_status").isNull() & F.col("markdown").isNull() & F.col("body_sha256").isNull() & (F.col("bytes_wire") == 0)
    return out.select("case_id", "status", "wall_ms", "request_count", empty.alias("empty"), F.array_join(said, ", ").alias("trace"))


@query(fixture_sql.ESCALATIONS)
def escalation_results(spark, sf_dir):
    """The extracting arm's escalations to the browser, and whether that had content."""
    out = benchmark.run_arms(fixtures.fixture_truths(spark), fixtures.fixture_responses(spark), ["extract-tf", "browser-local"])
    return out.filter("subject_id = 'extract-tf'").select("case_id", F.explode("escalations").alias("e")).select("case_id", "e.to_lane", "e.improved")


@query(cases.values([(i, want) for i, (_, _, want) in enumerate(cases.TABLES)], "id, issues"))
def table_verdicts(spark, sf_dir):
    """What the first table of small texts lacks of an expected one."""
    rows = spark.createDataFrame([(i, text, *spec) for i, (text, spec, _) in enumerate(cases.TABLES)], "id int, text string, columns int, rows int, cells map<string,string>, same_row array<string>, same_column array<string>, require boolean")
    issues = pages.expected_table_issues("text", "columns", "rows", "cells", "same_row", "same_column", "require")
    return rows.select("id", F.array_join(issues, "; ").alias("issues"))


@query(cases.values([(p, *rest[:-1], rest[-1].strip()) for p, *rest in cases.ENDS], "request_id, failure_reason, status, request_count, attempt_count, urls, final_path, delay_ms, events").replace(".0,", ".0::DOUBLE,"))
def transport_outcomes(spark, sf_dir):
    """Redirects, loops, limits, retries and errors over a small transcript."""
    rows = [(cases.U + p, n, status, {} if x is None else {"retry-after" if status == 503 else "location": x}, "", error, None, 1, 0, 0) for p, n, status, x, error in cases.ANSWERS]
    requests = local_rows(spark, [(p, cases.U + p) for p, *_ in cases.ENDS], "request_id string, url string")
    out = transport.resolve(requests, spark.createDataFrame(rows, transport.RESPONSES))
    events = F.array_join(F.transform("trace", lambda e: e["event"]), " ")
    return out.select("request_id", "failure_reason", "status", "request_count", "attempt_count", F.size("redirect_chain").alias("urls"), F.regexp_replace("final_url", "^" + cases.U, "").alias("final_path"), "delay_ms", events.alias("events"))


@query(cases.values([(i, want) for i, (_, _, want) in enumerate(cases.URLS)], "id, url"))
def resolved_urls(spark, sf_dir):
    rows = local_rows(spark, [(i, base, location) for i, (base, location, _) in enumerate(cases.URLS)], "id int, base string, location string")
    return rows.select("id", transport.resolve_url("base", "location").alias("url"))


@query(page_sql.pruned(False) + page_sql.EXTRACT + f""", a(subject_id, lane) AS (VALUES ('resilient-http', 'http'), ('browser-local', 'browser_local'))
SELECT subject_id, CASE WHEN page_id % 2 = 0 THEN 'canary-' ELSE 'canary2-' END || page_id AS case_id, lane, CASE WHEN escalate THEN 'failed' ELSE 'success' END AS status, CASE WHEN NOT escalate THEN {sql_tokens('main_html')} END AS content_tokens FROM extracted, a""")
def resilient_canaries(spark, sf_dir):
    """Stored pages through the arms with full transport."""
    return benchmark.run_arms(*canaries(spark, sf_dir), ["resilient-http", "browser-local"]).select("subject_id", "case_id", "lane", "status", "content_tokens")


@query("SELECT DISTINCT 't' || user_id AS task_id, event_type AS attempt_id, CAST(event_id % 7 AS INTEGER) AS step_id FROM events")
def upserted_steps(spark, sf_dir):
    """Steps written by two writers, the second of which repeats the first's: each key is there once."""
    steps = table(spark, sf_dir, "events").select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("task_id"), F.col("event_type").alias("attempt_id"), (F.col("event_id") % 7).cast("int").alias("step_id"))
    path = f"{scratch_dir(spark)}/steps-{uuid.uuid4().hex}"
    benchmark.upsert_steps(steps.filter("step_id < 5"), path, "a")
    benchmark.upsert_steps(steps, path, "b")
    return benchmark.read_steps(spark, path)


@query(OUTCOMES_SQL + " SELECT subject_id, count(*) AS n, CAST(sum(octet_length(encode(md))) AS BIGINT) AS bytes FROM o WHERE NOT late AND subject_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL) GROUP BY subject_id")
def run_artifacts(spark, sf_dir):
    """The artifacts that a run leaves, read back."""
    path = f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}"
    benchmark.write_run(outcomes_of(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/artifacts").groupBy("subject_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT 52 AS cases, 52 AS ids, 52 AS answered, 0 AS odd_paths, 0 AS odd_statuses")
def suite_integrity(spark, sf_dir):
    """Cases, different ids, cases whose target answers, targets that aren't paths, and statuses that don't exist."""
    t, answers = fixtures.fixture_truths(spark), fixtures.fixture_responses(spark).select(F.col("url").alias("target")).distinct()
    known = t.join(answers.withColumn("known", F.lit(True)), "target", "left")
    path = F.startswith("target", F.lit(fixtures.BASE + "/"))
    n = lambda c: c.cast("int")
    return known.agg(n(F.count("*")).alias("cases"), n(F.countDistinct("case_id")).alias("ids"), n(F.count_if("known")).alias("answered"), n(F.count_if(~path)).alias("odd_paths"), n(F.count_if(~F.col("expected_status").isin(policy.STATUSES))).alias("odd_statuses"))


@query()
def five_arm_scoreboard(spark, sf_dir):
    return score.suite_scores(benchmark.run_arms(fixtures.fixture_truths(spark), fixtures.fixture_responses(spark)))


@query(page_sql.pruned(False) + page_sql.EXTRACT + f", t AS ({sql_canary('golden-converter', '(SELECT page_id, ' + sql_golden('html') + ' AS md FROM pages)', sql_tokens('md'))} UNION ALL {sql_canary('extract-tf', 'extracted', sql_tokens('main_html'), 'NOT escalate')}) " + sql_tiers("t"))
def canary_tier_report(spark, sf_dir):
    """Stored pages as canary cases for two arms, by tier."""
    return score.tier_report(benchmark.run_arms(*canaries(spark, sf_dir), ["golden-converter", "extract-tf"]))


@query(page_sql.CONTAINER_SCORES)
def container_scores(spark, sf_dir):
    """The extractor's container scores by interval joins over the pruned nodes."""
    p = page_rows(spark, sf_dir)
    return intervals.container_scores(pages.text_blocks(p), pages.pruned_nodes(p))


@query(page_sql.nodes() + f" SELECT page_id, CAST(node_id AS INTEGER) AS node_id, {SAID} AS text FROM nodes n WHERE tag IN ('h1', 'p')")
def node_text(spark, sf_dir):
    """Text of each heading and paragraph, from the node relation."""
    n = pages.html_nodes(page_rows(spark, sf_dir))
    return intervals.text_content(n.filter(F.col("tag").isin("h1", "p")).select("page_id", "node_id", "last_id"), n)


@query(page_sql.nodes() + " SELECT u.page_id, CAST(u.node_id AS INTEGER) AS node_id, c.tag, count(*) AS n FROM nodes u JOIN nodes c ON c.page_id = u.page_id AND c.parent_id = u.node_id WHERE u.kind = 'element' AND c.kind = 'element' GROUP BY ALL")
def child_tags(spark, sf_dir):
    """How many children of each tag an element has."""
    n = pages.html_nodes(page_rows(spark, sf_dir)).filter("kind = 'element'").select("page_id", "node_id", "parent_id", "tag")
    return intervals.children(n, n).groupBy("page_id", F.col("a_node_id").alias("node_id"), F.col("c_tag").alias("tag")).agg(F.count("*").alias("n"))


@query(page_sql.nodes() + """, blocks AS (SELECT page_id, min(node_id) AS x, max(node_id) AS y FROM nodes WHERE tag IN ('p', 'li', 'td') GROUP BY page_id)
SELECT e.page_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(max(a.node_id) AS INTEGER) AS lca FROM blocks e LEFT JOIN nodes a ON a.page_id = e.page_id AND a.kind = 'element' AND a.node_id < x AND x <= a.last_id AND y BETWEEN a.node_id AND a.last_id GROUP BY ALL""")
def common_ancestors(spark, sf_dir):
    """The deepest element around the first and the last block of each page."""
    n = pages.html_nodes(page_rows(spark, sf_dir))
    ends = n.filter(F.col("tag").isin("p", "li", "td")).groupBy("page_id").agg(F.min("node_id").alias("x"), F.max("node_id").alias("y"))
    return intervals.common_ancestor(ends, n)


@query(page_sql.nodes() + " SELECT page_id, count(*) AS n FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes r WHERE r.page_id = n.page_id AND r.tag IN ('nav', 'ul') AND n.node_id BETWEEN r.node_id AND r.last_id) GROUP BY page_id")
def detached_nodes(spark, sf_dir):
    """Nodes left of each page without its navigation and lists."""
    n = pages.html_nodes(page_rows(spark, sf_dir))
    return intervals.detach(n, n.filter(F.col("tag").isin("nav", "ul"))).groupBy("page_id").agg(F.count("*").alias("n"))


@query(page_sql.BLOCK_RUNS)
def block_runs(spark, sf_dir):
    p = page_rows(spark, sf_dir)
    return intervals.longest_block_run(pages.text_blocks(p), pages.pruned_nodes(p))


@query(page_sql.pruned() + page_sql.EXTRACT + r""" SELECT page_id, regexp_replace(main_html, '((?:href|src)=")/', '\1' || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || '/', 'g') AS main_html FROM extracted JOIN src USING (page_id)""")
def normalised_links(spark, sf_dir):
    """Links of each page's main content, absolute and without tracking."""
    p = page_rows(spark, sf_dir)
    found = pages.extract_pages(p).select("page_id", "main_html").join(p.select("page_id", "url"), "page_id")
    return found.select("page_id", pages.absolute_links("main_html", "url").alias("main_html"))


SHELLS = [(1, '<div id="root"> </div><script>x</script>', 100), (2, "<NOSCRIPT>turn it on</NOSCRIPT>", 49), (3, "<noscript>x</noscript>", 50), (4, "<p>x</p>", 19), (5, "<p>x</p>", 20), (6, '<DIV class="a" id="__next"></DIV>', 0), (7, '<div id="rooted"></div>', 500)]


@query("WITH s(id, html, tokens) AS (VALUES " + ", ".join(f"({i}, '{h}', {t})" for i, h, t in SHELLS) + r"""), t AS (SELECT id, CASE WHEN regexp_matches(html, '(?i)<div[^>]*id="(root|app|__next)"[^>]*>\s*</div>') THEN 'spa_fingerprint' WHEN contains(lower(html), '<noscript') AND tokens < 50 THEN 'noscript_marker' WHEN tokens < 20 THEN 'low_token_yield' END AS reason FROM s)
SELECT id, reason, CASE WHEN reason IS NOT NULL THEN id % 2 = 0 END AS improved FROM t""".replace("\\\\", "\\"))
def escalations(spark, sf_dir):
    """Why a page is to be fetched again by a browser, and whether that found content."""
    rows = local_rows(spark, SHELLS, "case_id int, html string, tokens int").withColumn("trigger", policy.escalation_trigger(F.col("html"), F.col("tokens")))
    again = rows.filter("trigger is not null").select("case_id", F.lit("browser_local").alias("lane"), F.when(F.col("case_id") % 2 == 0, "success").otherwise("failed").alias("status"))
    steps = rows.select("case_id", "trigger", F.lit("browser_local").alias("to_lane"))
    return policy.improvements(steps, again).select(F.col("case_id").alias("id"), F.col("trigger").alias("reason"), "improved")


@query(f"""WITH t(doc_id, md) AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'Just a moment, Access denied' UNION ALL SELECT -2, '' UNION ALL SELECT -3, 'Please wait Please wait')
SELECT doc_id, CASE WHEN length(md) > 0 THEN ({" + ".join(f"(length(md) - length(replace(md, '{m}', '')))" for m in verdict.CHALLENGES)}) / length(md) ELSE 0.0 END AS share FROM t""")
def challenge_share(spark, sf_dir):
    """What part of each text interstitial phrases make up."""
    extra = local_rows(spark, [(-1, "Just a moment, Access denied"), (-2, ""), (-3, "Please wait Please wait")], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra).select("doc_id", verdict.challenge_share(F.col("text")).alias("share"))


@query("SELECT doc_id, lane IN ('http', 'browser_local') AS is_public FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'browser_local' WHEN 2 THEN 'provider' ELSE NULL END AS lane FROM documents)")
def public_lane(spark, sf_dir):
    i = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").select("doc_id", policy.is_public_lane(F.when(i == 0, "http").when(i == 1, "browser_local").when(i == 2, "provider")).alias("is_public"))


@query("SELECT 'e' || item_id AS id, 'site' AS platform, 'a \"quoted\", title' || chr(10) || item_id AS title, text AS signal FROM benchmark")
def ledger_scan(spark, sf_dir):
    """Benchmark passages written as an evidence ledger, and read back."""
    from ..sources import ledger

    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("id"), F.lit("site").alias("platform"), F.lit("2026-01-01").alias("date"), F.concat(F.lit('a "quoted", title\n'), F.col("item_id").cast("string")).alias("title"), *[F.lit("x").alias(c) for c in ("url", "evidence_type", "theme")], F.col("text").alias("signal"), F.lit("high").alias("confidence"))
    path = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return ledger.read_ledger(spark, path).select("id", "platform", "title", "signal")


@query("SELECT c.id, b.text AS signal FROM (SELECT 'b' || (item_id // 2) * 2 AS id FROM benchmark) c JOIN (SELECT 'b' || item_id AS id, text FROM benchmark) b USING (id)")
def cited_sources(spark, sf_dir):
    """Citations with the rows that they name."""
    from ..sources import ledger

    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("signal"))
    citations = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), (F.floor(F.col("item_id") / 2) * 2).cast("string")).alias("id"))
    return ledger.cited(citations, items)


@query(fixture_sql.PLAIN_ARM)
def segmented_scoreboard(spark, sf_dir):
    """Scores of the plain arm by category of case."""
    return score.suite_scores(benchmark.run_arms(fixtures.fixture_truths(spark), fixtures.fixture_responses(spark), ["bare-http"]), "category")


@query()
def environment_row(spark, sf_dir):
    return run_environment(spark)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By first path segment: pages, pages with content, and the median size of their main content."""
    return QUERIES["golden_yield_score"](spark, sf_dir).orderBy("segment")


