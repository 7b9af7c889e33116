"""Documents as the results of four arms: the frame that the checks and scores run over, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators.verdict import CHALLENGES, CHECKS, with_checks, with_outcomes, with_timeout
from .page_sql import C

ARMS = ["arm0", "arm1", "arm2", "arm3"]
BANNED = ["casino", "click here"]
MUST = [["the"], ["the", "de"], [], ["zzqx"]]
TABLE = "struct<columns:int,rows:int,cells:map<string,string>,same_row:array<string>,same_column:array<string>,require_markdown:boolean>"


def document_outcomes(docs: DataFrame) -> DataFrame:
    """Each document as what an arm made of a case: every value follows from its id and text."""
    i, text = F.col("doc_id"), F.col("text")
    moved = i % 7 == 0
    asked = F.concat(F.lit("https://x.test/"), i.cast("string"))
    other = F.lit("https://x.test/home")
    status = F.when(F.coalesce(F.length("text"), F.lit(0)) < 200, "failed").when(i % 13 == 0, "blocked").when(i % 3 == 0, "partial").otherwise("success")
    must = F.element_at(F.array(*[F.array(*map(F.lit, m)).cast("array<string>") for m in MUST]), (i % 4 + 1).cast("int"))
    rows = docs.select(
        F.concat(F.when(i % 2 == 0, "canary-").otherwise("canary2-"), F.floor(i / 4).cast("string")).alias("case_id"), F.concat(F.lit("arm"), (i % 4).cast("string")).alias("subject_id"), i.alias("doc_id"),
        text.alias("markdown"), asked.alias("requested_url"), F.when(moved, other).otherwise(asked).alias("final_url"), F.when(moved, F.array(asked, other)).otherwise(F.array().cast("array<string>")).alias("redirect_chain"),
        (i % 5 == 0).alias("truncated"), F.when(i % 10 == 0, F.lit(100).cast("long")).alias("truncated_at"), must.alias("must_contain"), F.array(*map(F.lit, BANNED)).alias("must_not_contain"),
        F.lit(None).cast(TABLE).alias("expected_table"), F.when(i % 3 == 0, F.struct(F.lit(120).alias("min"), F.lit(4000).alias("max"))).alias("expected_main_tokens"),
        status.alias("status"), F.when(i % 6 == 0, "browser_local").otherwise("http").alias("lane"), F.lit("success").alias("expected_status"), F.lit("http").alias("expected_lane"),
        (i * 7919 % 70_000).alias("wall_ms"), (i % 3 + 1).cast("int").alias("attempt_count"), F.when(status.isin("success", "partial"), estimate_tokens(text)).alias("content_tokens"),
        F.struct(F.lit(400).alias("max_tokens"), F.lit(30_000).alias("max_wall_ms"), F.lit(2).alias("max_attempts")).alias("budget"),
        F.when(status == "failed", "http_error").alias("failure_reason"), F.when(status == "blocked", "rate_limit").alias("block_reason"))
    return with_outcomes(with_checks(with_timeout(rows)))


def sql_tokens(t: str) -> str:
    cjk = f"length(regexp_replace({t}, '[^{C}]', '', 'g'))"
    return f"CAST(ceil((length({t}) + length(regexp_replace({t}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) - {cjk}) / 4.0) + {cjk} AS BIGINT)"


def sql_median(x: str, q: float = 0.5) -> str:
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL))[CAST(floor(count({x}) * {q}) AS BIGINT) + 1]"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


CHALLENGED = " OR ".join(f"contains(md, '{m}')" for m in CHALLENGES)
#: CTEs up to o, the outcomes, with the five checks as columns k1 to k5.
OUTCOMES_SQL = f"""WITH d AS (SELECT *, doc_id AS i, coalesce(length(text), 0) AS n, (doc_id * 7919) % 70000 AS ran FROM documents),
e AS (SELECT i AS doc_id, CASE WHEN i % 2 = 0 THEN 'canary-' ELSE 'canary2-' END || CAST(i // 4 AS VARCHAR) AS case_id, 'arm' || CAST(i % 4 AS VARCHAR) AS subject_id, ran >= 60000 AS late, least(ran, 60000) AS wall_ms, i % 3 + 1 AS attempts,
  CASE WHEN ran >= 60000 THEN 'budget_exceeded' WHEN n < 200 THEN 'failed' WHEN i % 13 = 0 THEN 'blocked' WHEN i % 3 = 0 THEN 'partial' ELSE 'success' END AS status,
  CASE WHEN ran >= 60000 THEN 'http' WHEN i % 6 = 0 THEN 'browser_local' ELSE 'http' END AS lane, CASE WHEN ran >= 60000 THEN '' ELSE coalesce(text, '') END AS md, i % 7 = 0 AND ran < 60000 AS moved,
  CASE i % 4 WHEN 0 THEN {_list(MUST[0])} WHEN 1 THEN {_list(MUST[1])} WHEN 2 THEN {_list(MUST[2])} ELSE {_list(MUST[3])} END AS must, i % 5 = 0 AND i % 10 <> 0 AND ran < 60000 AS lost, i % 3 = 0 AS sized FROM d),
f AS (SELECT *, CASE WHEN status IN ('success', 'partial') THEN {sql_tokens('md')} END AS content_tokens, len(list_filter(must, lambda x: NOT contains(md, x))) > 0 AS lacks FROM e),
g AS (SELECT *, CASE WHEN len(must) = 0 THEN 'unknown' WHEN md = '' OR lacks THEN 'fail' ELSE 'pass' END AS k1, CASE WHEN {CHALLENGED} THEN 'fail' ELSE 'pass' END AS k2,
  CASE WHEN md = '' OR NOT sized THEN 'unknown' WHEN {sql_tokens('md')} < 120 OR contains(md, 'casino') OR contains(md, 'click here') THEN 'fail' ELSE 'pass' END AS k3,
  CASE WHEN NOT moved THEN 'pass' WHEN len(must) = 0 THEN 'unknown' WHEN lacks THEN 'fail' ELSE 'pass' END AS k4, CASE WHEN lost THEN 'fail' ELSE 'pass' END AS k5 FROM f),
o AS (SELECT *, [k1, k2, k3, k4, k5] AS ks, status IN ('success', 'partial') AS contentful, status IN ('success', 'partial') AND list_contains([k1, k2, k3, k4, k5], 'fail') AS is_false_success,
  wall_ms <= 30000 AND attempts <= 2 AND (content_tokens IS NULL OR content_tokens <= 400) AS budget_respected FROM g),
k AS (SELECT doc_id, case_id, subject_id, unnest({_list(CHECKS)}) AS "check", unnest(ks) AS outcome FROM o)"""
