"""What the case suite's tables and its plain arm give: grids written out by hand, and the plain arm's scores in SQL."""

from __future__ import annotations

from ..operators.verdict import CHALLENGES
from ..sources import fixtures
from .outcome_sql import sql_median, sql_tokens

#: The logical grid of each table of the suite, read off its source.
GRIDS = {
    "static/table": [["Metal", "Melts at", "Mark"], ["Copper", "1085", "Cu"], ["Tin", "232", "Sn"], ["Zinc", "420", "Zn"]],
    "table/thead": [["Depth", "Sand"], ["4 m", "fine"]],
    "table/no-thead": [["Depth", "Sand"], ["4 m", "fine"]],
    "table/colspan": [["Season", "", ""], ["A1", "B1", "C1"]],
    "table/rowspan": [["Tidal range", "R1"], ["", "R2"], ["", "R3"]],
    "table/colrowspan": [["Origin", "", "M1"], ["", "", "R1"], ["L1", "", ""]],
    "table/nested": [["Outer cell of it", "plain text"], ["Inner cell here", ""]],
    "table/list-in-cell": [["Gear of the boat", "Use on the water"], ["ropesailoar", "rowing and sailing"]],
    "table/p-in-cell": [["Log of the day", "By whom"], ["the first partthe second part", "the keeper himself"]],
    "table/code-in-cell": [["Command", "Meaning"], [r"cat log \| tee copy", "keeps a copy"]],
    "table/empty-cell": [["Left", "Middle", "Right"], ["x", "", "y"]],
    "table/pipe-in-cell": [["Channel", "Value"], [r"a\|b", "two"]],
    "table/ragged": [["one of it", "two of it", "three of it", ""], ["four of it", "five of it", "", ""], ["six of it", "seven of it", "eight of it", "nine of it"]],
    "table/empty-table": [],
    "table/single-cell": [["the only cell of a layout table"]],
    "table/caption": [["Month", "Tons"], ["May", "31"]],
    "table/large": [[f"Column {c}" for c in range(10)], *[[f"r{r}c{c}" + "x" * (r % 3) for c in range(10)] for r in range(100)]],
    "table/colspan-amplification": [["Wide one", *[""] * 9999, "Follower of it"]],
    "table/large-colspan": [["Group", "", "", "Tail"], ["a1", "b1", "c1", "d1"], ["a2", "b2", "c2", "d2"]],
    "pt/product": [["Property", "Value"], ["Weight", "2 kg"], ["Height", "31 cm"]],
}
CAPTIONS = {"table/caption": "Catch by month\n"}
#: The annotated cases, none of whose tables lacks anything in the table arm's text.
ANNOTATED = "static-table table-thead table-no-thead table-colspan table-rowspan table-colrowspan table-empty-cell table-pipe-in-cell table-caption table-large table-large-colspan pt-product".split()


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def written(path: str, grid: list[list[str]]) -> str:
    lines = [grid[0], ["---"] * len(grid[0]), *grid[1:]] if grid else []
    return CAPTIONS.get(path, "") + "\n".join("| " + " | ".join(cells) + " |" for cells in lines)


GFM_TABLES = "SELECT * FROM (VALUES " + ", ".join(f"('{fixtures.BASE}/{p}', 0, {quoted(written(p, g))})" for p, g in GRIDS.items()) + ") t(page_id, nth, gfm)"
TABLE_CHECK = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '')" for c in ANNOTATED) + ") t(case_id, issues)"


def plain_arm() -> str:
    """CTEs up to k, the cases of the arm that takes the first answer as it is; its text is HTML, so no expected table is found in it."""
    rows = []
    for c in fixtures._cases():
        a, (tokens, wall, attempts) = c["answers"][0], c["budget"]
        listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]::VARCHAR[]"
        rows.append(f"({quoted(c['id'])}, {quoted(c['category'])}, {quoted(c['status'])}, {a.get('status') or 'NULL'}, {quoted(a.get('body'))}, {quoted(a.get('error_name'))}, {a.get('wall_ms', 5)}, {listed(c['must'])}, {listed(c['ban'])}, {c['grid'] is not None}, {c['tokens'][0] if c['tokens'] else 'NULL'}, {tokens}, {wall}, {attempts})")
    challenged = " OR ".join(f"contains(md, '{m}')" for m in CHALLENGES)
    return f"""WITH c(id, category, wanted, code, body, error, ran, must, ban, grid, least, most_tokens, most_ms, most_attempts) AS (VALUES {", ".join(rows)}),
s AS (SELECT *, CAST(least(ran, 60000) AS BIGINT) AS wall_ms, CASE WHEN ran >= 60000 THEN 'budget_exceeded' WHEN error IS NULL AND code = 200 THEN 'success' ELSE 'failed' END AS status FROM c),
m AS (SELECT *, CASE WHEN status = 'success' THEN coalesce(body, '') ELSE '' END AS md, CASE WHEN status = 'success' THEN {sql_tokens("coalesce(body, '')")} END AS content_tokens FROM s),
k AS (SELECT *, (len(must) > 0 OR grid) AND (md = '' OR grid OR len(list_filter(must, lambda x: NOT contains(md, x))) > 0) AS k1, {challenged} AS k2,
  md <> '' AND least IS NOT NULL AND ({sql_tokens('md')} < least OR len(list_filter(ban, lambda x: contains(md, x))) > 0) AS k3 FROM m)"""


FIRST = ", ".join(f"('{fixtures.BASE}{c['path']}', {a.get('status') or 200}, {quoted(a.get('body') or '')}, {a.get('wall_ms', 5)}::BIGINT)" for c in fixtures._cases() for a in c["answers"][:1])
EMITTED = f"WITH a(url, status, body, delay_ms) AS (VALUES {FIRST}), m(method) AS (VALUES ('GET'), ('HEAD')) SELECT url, method, status, CAST(octet_length(encode(body)) AS INTEGER) AS content_length, CASE WHEN method = 'GET' THEN length(body) ELSE 0 END AS sent, delay_ms FROM a, m"
#: Cases whose answer the extractor finds nothing in, and those of them that a rendering helps.
ESCALATED = "spa-shell spa-delayed empty-legit empty-body block-challenge-200 block-login-wall soft-404 limit-zip-bomb limit-huge-body limit-non-html".split()
RENDERED = {"spa-shell", "spa-delayed"}
ESCALATIONS = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', 'browser_local', {str(c in RENDERED).lower()})" for c in ESCALATED) + ") t(case_id, to_lane, improved)"
PLAIN_CASES = plain_arm() + """ SELECT id AS case_id, status, CASE WHEN status <> 'failed' THEN NULL WHEN error IS NOT NULL OR code IS NULL THEN 'connection_error' ELSE 'http_error' END AS failure_reason, content_tokens, wall_ms,
status = wanted AS status_matched, status = 'success' AND (k1 OR k2 OR k3) AS is_false_success FROM k"""
PLAIN_ARM = plain_arm() + f""" SELECT 'bare-http' AS subject_id, category, count(*) AS case_count, count(*) FILTER (status = wanted) AS status_match_count, count(*) FILTER (status = 'success') AS contentful_count, count(*) FILTER (status = 'success' AND (k1 OR k2 OR k3)) AS false_success_count,
  count(*) FILTER (status = 'success' AND (k1 OR k2 OR k3)) / nullif(count(*) FILTER (status = 'success'), 0) AS false_success_rate, {sql_median('wall_ms')} AS median_wall_ms, {sql_median('wall_ms', 0.95)} AS p95_wall_ms, {sql_median('content_tokens')} AS median_content_tokens,
  count(*) FILTER (wall_ms > most_ms OR 1 > most_attempts OR content_tokens > most_tokens) AS budget_violations FROM k GROUP BY category"""
