"""The fixture suite: 52 annotated cases and the recorded responses that answer them, as two small tables.

Pages are built here, in our own words; only what drives behaviour is fixed: paths, statuses, shapes and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transport import RESPONSES

BASE = "http://fixtures.local"
NAME, VERSION = "fixtures", "0.1.0"
TRUTH = (
    "case_id string, target string, kind string, category string, must_contain array<string>, must_not_contain array<string>, "
    "expected_table struct<columns:int,rows:int,cells:map<string,string>,same_row:array<string>,same_column:array<string>,require_markdown:boolean>, "
    "expected_lane string, empty_is_legit boolean, expected_main_tokens struct<min:int,max:int>, budget struct<max_tokens:int,max_wall_ms:int,max_attempts:int>, expected_status string, notes string"
)
#: What the frame around content pages says, and extraction must not.
CHROME = ["Harbor Gazette navigation", "We store small files", "Sidebar of further links", "Imprint and house rules"]
WORDS = "harbor engine river copper winter signal market garden ladder window story bridge metal letter island candle".split()


def prose(sentences: int, seed: int) -> str:
    """Sentences that a seed fixes."""
    out, x = [], seed
    for _ in range(sentences):
        words = []
        for _ in range(9):
            x = (x * 1103515245 + 12345) % 2**31
            words.append(WORDS[(x >> 16) % len(WORDS)])
        out.append(" ".join(words).capitalize() + ".")
    return " ".join(out)


def framed(body: str, title: str = "Harbor Gazette", head: str = "") -> str:
    nav = f'<nav class="top"><a href="/home">{CHROME[0]}</a></nav>'
    consent = f'<div id="cookie-consent">{CHROME[1]} <button>Fine</button></div>'
    side = f'<aside><p>{CHROME[2]}</p></aside>'
    foot = f"<footer><p>{CHROME[3]}</p></footer>"
    return f"<!DOCTYPE html><html><head><title>{title}</title>{head}</head><body>{nav}{consent}{body}{side}{foot}</body></html>"


def table(rows: list[list[str]], head: bool = True) -> str:
    cell = lambda c, t: c if c.startswith("<t") else f"<{t}>{c}</{t}>"
    lines = ["<tr>" + "".join(cell(c, "th" if i == 0 else "td") for c in r) + "</tr>" for i, r in enumerate(rows)]
    return f"<table><thead>{lines[0]}</thead><tbody>{''.join(lines[1:])}</tbody></table>" if head else f"<table>{''.join(lines)}</table>"


def article(inner: str) -> str:
    return f"<article>{inner}</article>"


def _cases() -> list[dict]:
    out: list[dict] = []

    def case(id_, path, category, status="success", lane="http", tokens=None, budget=(2000, 10_000, 2), must=(), ban="chrome", grid=None, answers=(), kind="fixture", **answer):
        if not answers:
            answers = [{"status": 200, "headers": {"content-type": "text/html; charset=utf-8"}, "wall_ms": 5, **answer}]
        out.append({"id": id_, "path": path, "category": category, "status": status, "lane": lane, "tokens": tokens, "budget": budget, "must": list(must), "ban": CHROME if ban == "chrome" else list(ban), "grid": grid, "answers": answers})

    html = {"content-type": "text/html; charset=utf-8"}
    facts = lambda *x: "".join(f"<p>{f} This line is here so that the fact stands in prose.</p>" for f in x)
    paragraphs = lambda n, seed, size=4: "".join(f"<p>{prose(size, seed + i)}</p>" for i in range(n))

    case("static-article", "/static/article", "static", tokens=(260, 900), must=["The lighthouse was lit in 1871.", "Its keeper counted 402 steps."], body=framed(article("<h1>The old lighthouse</h1><h2>How it came to be</h2>" + paragraphs(11, 7, 2) + facts("The lighthouse was lit in 1871.", "Its keeper counted 402 steps."))))
    case("static-cjk", "/static/cjk", "static", tokens=(60, 400), must=["灯塔建于一八七一年"], body=framed(article("<h1>老灯塔</h1>" + "".join(f"<p>{t}</p>" for t in ("灯塔建于一八七一年，海边的人们都记得那一天的风和浪。", "守塔人每天走四百零二级台阶，从不抱怨风雨和黑夜。", "如今灯塔成了博物馆，孩子们在那里听海的故事。")))))
    case("static-table", "/static/table", "static", tokens=(60, 500), must=["Copper", "Tin", "Zinc"], grid={"columns": 3, "rows": 4, "cells": {"0,0": "Metal", "1,0": "Copper", "2,1": "232"}, "same_row": ["Zinc", "420"]}, body=framed(article("<h1>Metals</h1><p>" + prose(2, 21) + "</p>" + table([["Metal", "Melts at", "Mark"], ["Copper", "1085", "Cu"], ["Tin", "232", "Sn"], ["Zinc", "420", "Zn"]]) + paragraphs(2, 23, 2))))
    case("static-long", "/static/long", "long_content", tokens=(3000, 20_000), budget=(30_000, 10_000, 2), must=["The first crate held maps.", "The last crate held salt."], body=framed(article("<h1>The inventory</h1>" + facts("The first crate held maps.") + paragraphs(60, 100, 6) + facts("The last crate held salt."))))

    def tab(name, must, rows, spec=None, tokens=(15, 120), budget=(1000, 10_000, 2), head=True, source=None):
        grid = spec and {"columns": spec[0], "rows": spec[1], "cells": spec[2]}
        case(f"table-{name}", f"/table/{name}", "table", tokens=tokens, budget=budget, must=must, grid=grid, body=framed(article(f"<h1>Table {name}</h1>{source or table(rows, head)}")))

    tab("thead", ["Depth"], [["Depth", "Sand"], ["4 m", "fine"]], (2, 2, {"0,0": "Depth", "1,1": "fine"}))
    tab("no-thead", ["Depth", "fine"], [["Depth", "Sand"], ["4 m", "fine"]], (2, 2, {"1,0": "4 m"}), head=False)
    tab("colspan", ["Season"], [['<th colspan="3">Season</th>'], ["A1", "B1", "C1"]], (3, 2, {"0,0": "Season", "0,2": "", "1,2": "C1"}), head=False)
    tab("rowspan", ["Tidal range"], [['<th rowspan="3">Tidal range</th>', "R1"], ["R2"], ["R3"]], (2, 3, {"0,0": "Tidal range", "1,0": "", "2,1": "R3"}), head=False)
    tab("colrowspan", ["Origin"], [['<th rowspan="2" colspan="2">Origin</th>', "M1"], ["R1"], ["L1", "", ""]], (3, 3, {"0,0": "Origin", "1,2": "R1", "2,0": "L1"}), head=False)
    tab("nested", ["Outer", "Inner"], [], tokens=(20, 200), source="<table><tr><th>Outer cell of it</th><td>plain text</td></tr><tr><td><table><tr><td>Inner cell here</td></tr></table></td><td>beside the other</td></tr></table>")
    tab("list-in-cell", ["rope", "sail", "oar"], [["Gear of the boat", "Use on the water"], ["<ul><li>rope</li><li>sail</li><li>oar</li></ul>", "rowing and sailing"]], tokens=(20, 200))
    tab("p-in-cell", ["first part", "second part"], [["Log of the day", "By whom"], ["<p>the first part</p><p>the second part</p>", "the keeper himself"]], tokens=(20, 200))
    tab("code-in-cell", ["tee"], [["Command", "Meaning"], ["<code>cat log | tee copy</code>", "keeps a copy"]], tokens=(15, 200))
    tab("empty-cell", ["Left", "Right"], [["Left", "Middle", "Right"], ["x", "", "y"]], (3, 2, {"1,0": "x", "1,1": "", "1,2": "y"}))
    tab("pipe-in-cell", ["Channel"], [["Channel", "Value"], ["a|b", "two"]], (2, 2, {"1,0": r"a\|b"}))
    tab("ragged", ["one", "nine"], [["one of it", "two of it", "three of it"], ["four of it", "five of it"], ["six of it", "seven of it", "eight of it", "nine of it"]], tokens=(20, 200), head=False)
    tab("empty-table", [], [], tokens=(0, 60), source="<table></table><p>Nothing was recorded on that day, says the log.</p>")
    tab("single-cell", ["only cell"], [["the only cell of a layout table"]], tokens=(5, 120), head=False)
    tab("caption", ["Catch by month"], [], (2, 2, {"0,0": "Month", "1,1": "31"}), source="<table><caption>Catch by month</caption><tr><th>Month</th><th>Tons</th></tr><tr><td>May</td><td>31</td></tr></table>")
    big = [[f"Column {c}" for c in range(10)], *[[f"r{r}c{c}" + "x" * (r % 3) for c in range(10)] for r in range(100)]]
    tab("large", ["Column 0", "r99c9"], big, (10, 101, {"100,9": "r99c9"}), tokens=(1800, 8000), budget=(20_000, 15_000, 2))
    tab("colspan-amplification", ["Wide", "Follower"], [], tokens=(5, 200), budget=(1000, 15_000, 2), source='<table><tr><td colspan="10000">Wide one</td><td>Follower of it</td></tr></table>')
    tab("large-colspan", ["Group", "Tail"], [['<th colspan="3">Group</th>', "<th>Tail</th>"], ["a1", "b1", "c1", "d1"], ["a2", "b2", "c2", "d2"]], (4, 3, {"0,0": "Group", "0,3": "Tail", "2,3": "d2"}), tokens=(15, 200), budget=(2000, 10_000, 2), head=False)

    items = lambda n: "".join(f'<li><a href="/item/{i}">Entry {i} of the list</a> seen on the pier in week {i}</li>' for i in range(n))
    case("pt-listing", "/pt/listing", "page_type", tokens=(50, 800), must=["Entry 0", "Entry 9"], body=framed(f"<main><h1>Sightings</h1><ul>{items(10)}</ul></main>"))
    ld = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"Brass lamp"}</script>'
    case("pt-product", "/pt/product", "page_type", tokens=(40, 900), must=["Brass lamp", "Weight"], grid={"columns": 2, "rows": 3, "cells": {"1,0": "Weight"}}, body=framed("<main><h1>Brass lamp</h1>" + table([["Property", "Value"], ["Weight", "2 kg"], ["Height", "31 cm"]]) + f"<p>{prose(2, 40)}</p></main>", head=ld))
    section = lambda name, k: f'<section><h2>{name}</h2><ul><li><a href="/c/{k}">{name} one</a> with a note on it</li><li><a href="/c/{k + 1}">{name} two</a> with a note on it</li></ul></section>'
    case("pt-collection", "/pt/collection", "page_type", tokens=(35, 900), must=["Boats one", "Lamps two", "House of it all"], body=framed(f"<main><h1>House of it all</h1>{section('Boats', 0)}{section('Lamps', 2)}<p>{prose(1, 50)}</p></main>"))
    case("pt-forum", "/pt/forum", "page_type", tokens=(35, 900), must=["Which rope", "Hemp holds", "Try linen"], body=framed("<main><h1>Which rope lasts</h1>" + "".join(f'<article class="post"><h2>{t}</h2><p>{t} best, as far as we have seen it here. {prose(1, s)}</p></article>' for t, s in (("Hemp holds", 60), ("Try linen", 61))) + "</main>"))
    case("static-list", "/static/list", "listing", tokens=(40, 600), must=["Entry 0", "Entry 11"], body=framed(f"<main><h1>All sightings</h1><ul>{items(12)}</ul></main>"))
    case("static-malformed", "/static/malformed", "static", tokens=(20, 400), must=["the anchor weighs 90 kg"], ban=[], body=f"<html><body><div class=page><h1>Broken page<p>We know that <b>the anchor weighs 90 kg. {prose(2, 70)}<ul><li>one<li>two</ul></i></div></em><p>{prose(1, 71)}")
    spa = framed('<div id="root"></div><script>render("The ferry leaves at nine.")</script>', "App")
    seen = framed(article(f"<h1>Ferry</h1><p>The ferry leaves at nine. {prose(2, 80)}</p>"), "App")
    case("spa-shell", "/spa/shell", "spa", lane="browser_local", tokens=(10, 300), budget=(2000, 20_000, 2), must=["The ferry leaves at nine."], body=spa, rendered_html=seen)
    case("spa-delayed", "/spa/delayed", "spa", lane="browser_local", tokens=(10, 300), budget=(2000, 20_000, 2), must=["The ferry leaves at nine."], body=spa.replace("render(", "setTimeout(render, 600, "), rendered_html=seen)
    case("empty-legit", "/empty/legit", "empty", "empty_verified", tokens=(0, 25), budget=(500, 10_000, 2), body=framed("<main><h1>No results</h1></main>"))
    case("empty-body", "/empty/body", "empty", "empty_verified", tokens=(0, 5), budget=(500, 10_000, 2), body="")
    wall = "<html><head><title>Just a moment...</title></head><body><h1>Checking your browser</h1><p>Enable JavaScript and cookies to continue.</p></body></html>"
    case("block-challenge", "/block/challenge", "blocked", "blocked", budget=(500, 10_000, 2), ban=["Checking your browser", "Just a moment"], answers=[{"status": 403, "headers": {**html, "cf-mitigated": "challenge"}, "body": wall, "wall_ms": 5}])
    case("block-challenge-200", "/block/challenge-200", "blocked", "blocked", budget=(500, 10_000, 2), ban=["Checking your browser"], body=wall)
    case("block-rate-limit", "/block/rate-limit", "blocked", "blocked", budget=(500, 10_000, 2), ban=["Too many"], answers=[{"status": 429, "headers": {**html, "retry-after": "2"}, "body": "<p>Too many requests.</p>", "wall_ms": 5}])
    case("block-login-wall", "/block/login-wall", "blocked", "blocked", budget=(500, 10_000, 2), ban=["Sign in to read"], body="<html><body><form><h1>Sign in to read</h1><input name=user><input name=pass></form></body></html>")
    lost = "<html><head><title>Not found</title></head><body><h1>Nothing lives here</h1><p>The page that you asked for is gone.</p></body></html>"
    case("soft-404", "/wrong/soft-404", "wrong_page", "failed", budget=(500, 10_000, 2), ban=["Nothing lives here"], body=lost)
    to = lambda where: {"status": 302, "headers": {"location": where}, "body": "", "wall_ms": 5}
    case("redirect-to-home", "/wrong/redirect-home", "wrong_page", "failed", budget=(500, 10_000, 2), ban=[], answers=[to("/home")])
    case("redirect-chain", "/redirect/chain/3", "redirect", tokens=(5, 200), budget=(1000, 10_000, 2), must=["end of the chain"], answers=[to("/redirect/chain/2")])
    case("redirect-loop", "/redirect/loop/a", "redirect", "failed", budget=(500, 10_000, 1), ban=[], answers=[to("/redirect/loop/b")])
    case("timeout-headers", "/timeout/headers", "timeout", "failed", budget=(500, 2000, 1), ban=[], answers=[{"error_name": "HeadersTimeoutError", "wall_ms": 10_000}])
    case("timeout-body", "/timeout/body", "timeout", "failed", budget=(500, 2000, 1), ban=[], answers=[{"status": 200, "headers": html, "body": None, "error_name": None, "wall_ms": 60_000}])
    case("limit-zip-bomb", "/limit/zip-bomb", "resource_limit", "failed", budget=(500, 15_000, 1), ban=[], body="0" * 4096, headers={**html, "content-encoding": "gzip"}, bytes_wire=51_000, bytes_decompressed=51_000_000)
    case("limit-huge-body", "/limit/huge-body", "resource_limit", "failed", budget=(500, 15_000, 1), ban=[], body="<p>" + "y" * 4096, bytes_wire=11_000_000, bytes_decompressed=11_000_000)
    case("limit-non-html", "/limit/binary", "resource_limit", "failed", budget=(500, 10_000, 2), ban=[], body="\x89PNG", headers={"content-type": "image/png"})
    twin = framed(article("<h1>Twin page</h1><p>The twin stands at three doors.</p>" + paragraphs(6, 90, 2)))
    for letter, tail in (("a", "a"), ("b", "b"), ("c", "c?utm_source=x")):
        case(f"duplicate-{letter}", f"/duplicate/{tail}", "duplicate", tokens=(100, 600), must=["The twin stands at three doors."], body=twin)
    case("error-500", "/error/500", "http_error", "failed", budget=(500, 10_000, 2), ban=["Something broke"], answers=[{"status": 500, "headers": html, "body": "<h1>Something broke</h1>", "wall_ms": 5}])
    case("error-404", "/error/404", "http_error", "failed", budget=(500, 10_000, 1), ban=[], answers=[{"status": 404, "headers": html, "body": "<h1>No such page</h1>", "wall_ms": 5}])
    calm = framed(article(f"<h1>Back again</h1><p>The second knock opened the door. {prose(1, 95)}</p>"))
    case("flaky-once", "/flaky/once", "retry", tokens=(5, 200), budget=(1000, 10_000, 2), must=["The second knock opened the door."], answers=[{"status": 503, "headers": {**html, "retry-after": "0"}, "body": "busy", "wall_ms": 5}, {"status": 200, "headers": html, "body": calm, "wall_ms": 5}])
    case("home", "/home", "support", tokens=(10, 300), budget=(1000, 10_000, 2), must=["Welcome to the harbor"], ban=[], body=framed(article(f"<h1>Welcome to the harbor</h1><p>Welcome to the harbor. {prose(1, 98)}</p>")))
    return out


def _support() -> list[tuple[str, dict]]:
    """Answers of paths that only redirects lead to."""
    to = lambda where: {"status": 302, "headers": {"location": where}, "body": "", "wall_ms": 5}
    end = framed(article(f"<h1>Arrived</h1><p>This is the end of the chain, as was said. {prose(1, 97)}</p>"))
    return [("/redirect/chain/2", to("/redirect/chain/1")), ("/redirect/chain/1", to("/redirect/chain/0")), ("/redirect/chain/0", {"status": 200, "headers": {"content-type": "text/html"}, "body": end, "wall_ms": 5}), ("/redirect/loop/b", to("/redirect/loop/a"))]


def fixture_truths(spark: SparkSession, base: str = BASE) -> DataFrame:
    """The annotated cases, their targets bound to a base URL."""
    base = base.removesuffix("/")
    rows = []
    for c in _cases():
        grid = c["grid"] and (c["grid"]["columns"], c["grid"]["rows"], c["grid"].get("cells"), c["grid"].get("same_row"), c["grid"].get("same_column"), c["grid"].get("require_markdown"))
        rows.append((c["id"], base + c["path"], "fixture", c["category"], c["must"], c["ban"], grid, c["lane"], c["id"] in ("empty-legit", "empty-body"), c["tokens"], c["budget"], c["status"], None))
    return spark.createDataFrame(rows, TRUTH)


def fixture_responses(spark: SparkSession, base: str = BASE) -> DataFrame:
    """The transcript: what each URL answers on its n-th visit (the last row of a URL answers all later ones too)."""
    base = base.removesuffix("/")
    answers = [(c["path"], i, a) for c in _cases() for i, a in enumerate(c["answers"], 1)] + [(p, 1, a) for p, a in _support()]
    rows = []
    for path, visit, a in answers:
        body = a.get("body")
        size = len((body or "").encode())
        rows.append((base + path, visit, a.get("status"), a.get("headers"), body, a.get("error_name"), a.get("rendered_html"), a.get("wall_ms", 5), a.get("bytes_wire", size), a.get("bytes_decompressed", size)))
    return spark.createDataFrame(rows, RESPONSES)


def emitted(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests(url, method, visit_no) with what the fixture server sends: status (200 where none is recorded), content_length,
    body (none for HEAD) and delay_ms. A URL without an answer gives no row."""
    rows = requests.join(responses, ["url", "visit_no"])
    head = F.upper("method") == "HEAD"
    body = F.coalesce("body", F.lit(""))
    return rows.select("url", "method", "visit_no", F.coalesce("status", F.lit(200)).alias("status"), F.octet_length(body).alias("content_length"), F.when(head, "").otherwise(body).alias("body"), F.col("wall_ms").alias("delay_ms"))


def canary_truths(pages: DataFrame) -> DataFrame:
    """Stored pages as canary cases without annotations; the last digit of the id parts the two tiers."""
    prefix = F.when(F.col("page_id") % 2 == 0, "canary-").otherwise("canary2-")
    nothing = F.array().cast("array<string>")
    schema = pages.sparkSession.createDataFrame([], TRUTH).schema
    return pages.select(
        F.concat(prefix, F.col("page_id").cast("string")).alias("case_id"), F.col("url").alias("target"), F.lit("canary").alias("kind"), F.lit("article").alias("category"), nothing.alias("must_contain"), nothing.alias("must_not_contain"),
        F.lit(None).cast(schema["expected_table"].dataType).alias("expected_table"), F.lit("http").alias("expected_lane"), F.lit(False).alias("empty_is_legit"), F.lit(None).cast(schema["expected_main_tokens"].dataType).alias("expected_main_tokens"),
        F.struct(F.lit(4000).alias("max_tokens"), F.lit(30_000).alias("max_wall_ms"), F.lit(2).alias("max_attempts")).alias("budget"), F.lit("success").alias("expected_status"), F.when(F.col("page_id") % 2 == 0, "tier 1").otherwise("tier 2").alias("notes"))


def page_responses(pages: DataFrame) -> DataFrame:
    """Stored pages as a transcript: each answers 200 with its HTML."""
    size = F.octet_length("html").cast("bigint")
    return pages.select(
        "url", F.lit(1).alias("visit_no"), F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), F.col("html").alias("body"), F.lit(None).cast("string").alias("error_name"),
        F.lit(None).cast("string").alias("rendered_html"), F.lit(0).cast("bigint").alias("wall_ms"), size.alias("bytes_wire"), size.alias("bytes_decompressed"))
