"""Operators on small frames, the fixture suite through the five arms, streams against batches, all queries against SQL."""

import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from strandline.functions import js, text
from strandline.operators import golden, intervals, pages, policy, robots, score, transport, verdict, windows
from strandline.functions import dom, extract
from strandline.plans import benchmark, queries
from strandline.plans import sql as names
from strandline.sources import fixtures, ledger
from strandline.sources.environment import run_environment
from strandline.streaming import events as streaming

from conftest import SMALL


def test_text_expressions_equal_the_workers(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice(["a", "b.", " ", " ", "漢", "한", "😀", "?", "\n", "﻿", '"', "é", "x" * 9]) for _ in range(rng.randrange(30))),) for _ in range(200)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    for r in df.select("t", text.squeeze(t).alias("s"), text.strip(t).alias("e"), text.utf16_length(t).alias("u"), text.estimate_tokens(t).alias("n"), text.is_cjk(t).alias("c"), text.looks_prose(t).alias("p")).collect():
        assert (r.s, r.e, r.u, r.n, r.c, r.p) == (js.squeeze(r.t), js.strip(r.t), js.units(r.t), js.estimate_tokens(r.t), js.is_cjk(r.t), js.looks_prose(r.t))


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (4, 1, 3, 2)] + [("b", None), ("c", 5)], "k string, x int")
    got = dict(df.groupBy("k").agg(text.upper_median("x")).collect())
    assert got == {"a": 3, "b": None, "c": 5}


# robots


def glob(pattern, path):
    anchored = pattern.endswith("$")
    body = pattern[:-1] if anchored else pattern
    return re.match("".join(".*" if c == "*" else re.escape(c) for c in re.sub(r"\*+", "*", body)) + (r"\Z" if anchored else ""), path, re.S) is not None


def test_robots(spark):
    rng = random.Random(3)
    make = lambda n: "/" + "".join(rng.choice(r"ab/*$%_\.?") for _ in range(rng.randrange(n)))
    rules = [("h", make(7), rng.random() < 0.5) for _ in range(40)] + [("e", "", False), ("t", "/x", True), ("t", "/x", False), ("w", "/foo/*/bar", False)]
    paths = [("h", make(12)) for _ in range(150)] + [("e", "/any"), ("none", "/x"), ("t", "/xy"), ("w", "/foo/bar"), ("w", "/foo/a/b/bar/c")]
    got = robots.is_allowed(spark.createDataFrame(paths, "host string, path string"), spark.createDataFrame(rules, "host string, pattern string, allow boolean")).collect()
    assert len(got) == len(paths)
    for r in got:
        hits = [(len(p), a) for h, p, a in rules if h == r.host and glob(p, r.path)]
        assert r.allowed == max(hits, default=(0, True))[1], r


# transport


def transcript(spark, rows):
    full = [(u, v, s, h, "body", e, None, 1, 4, 4) for u, v, s, h, e in rows]
    return spark.createDataFrame(full, transport.RESPONSES)


U = "http://t.test"


def test_transport(spark):
    to = lambda where: {"location": where}
    rows = [
        (f"{U}/ok", 1, 200, {}, None), (f"{U}/404", 1, 404, {}, None), (f"{U}/429", 1, 429, {"retry-after": "1"}, None), (f"{U}/a/b", 1, 302, to("sibling"), None), (f"{U}/a/sibling", 1, 200, {}, None),
        (f"{U}/l1", 1, 302, to("/l2"), None), (f"{U}/l2", 1, 302, to("/l1"), None), (f"{U}/ftp", 1, 302, to("ftp://x.test/"), None), (f"{U}/none", 1, 302, {}, None), (f"{U}/304", 1, 304, {}, None),
        (f"{U}/flaky", 1, 503, {"retry-after": "9999"}, None), (f"{U}/flaky", 2, 200, {}, None), (f"{U}/down", 1, 503, {}, None), (f"{U}/r", 1, 302, to("/flaky"), None),
        (f"{U}/slow", 1, None, None, "HeadersTimeoutError"), (f"{U}/cut", 1, None, None, "SocketError"), *[(f"{U}/h{i}", 1, 302, to(f"/h{i + 1}"), None) for i in range(7)], (f"{U}/h7", 1, 200, {}, None)]
    urls = ["ok", "404", "429", "a/b", "l1", "ftp", "none", "304", "flaky", "down", "r", "slow", "cut", "h0", "h2", "missing"]
    requests = spark.createDataFrame([(u, f"{U}/{u}") for u in urls], "request_id string, url string")
    got = {r.request_id: r for r in transport.resolve(requests, transcript(spark, rows)).collect()}
    short = {k: (r.failure_reason, r.status, r.request_count, r.attempt_count, len(r.redirect_chain), r.final_url.removeprefix(U)) for k, r in got.items()}
    assert short == {
        "ok": (None, 200, 1, 1, 1, "/ok"), "404": (None, 404, 1, 1, 1, "/404"), "429": (None, 429, 1, 1, 1, "/429"), "a/b": (None, 200, 2, 1, 2, "/a/sibling"), "l1": ("redirect_loop", 302, 2, 1, 2, "/l1"),
        "ftp": ("policy_denied", 302, 1, 1, 1, "/ftp"), "none": ("http_error", 302, 1, 1, 1, "/none"), "304": ("http_error", 304, 1, 1, 1, "/304"), "flaky": (None, 200, 2, 2, 1, "/flaky"), "down": (None, 503, 2, 2, 1, "/down"),
        "r": (None, 200, 3, 2, 2, "/flaky"), "slow": ("timeout", None, 1, 1, 1, "/slow"), "cut": ("connection_error", None, 1, 1, 1, "/cut"), "h0": ("redirect_limit", 302, 6, 1, 6, "/h5"), "h2": (None, 200, 6, 1, 6, "/h7"),
        "missing": ("connection_error", None, 1, 1, 1, "/missing")}
    assert got["flaky"].delay_ms == 2000 and [e.event for e in got["flaky"].trace] == ["request_complete", "retry", "request_complete"]
    assert [e.event for e in got["l1"].trace][-1] == "redirect_loop"


# the suite


@pytest.fixture(scope="module")
def outcomes(spark):
    return benchmark.run_arms(fixtures.fixture_truths(spark), fixtures.fixture_responses(spark)).cache()


def test_suite_is_whole(spark):
    truths = fixtures.fixture_truths(spark).collect()
    assert len(truths) == 52 == len({t.case_id for t in truths}) and len({t.category for t in truths}) >= 15
    answers = {r.url for r in fixtures.fixture_responses(spark).collect()}
    assert all(t.target in answers for t in truths)


def test_bare_arm(outcomes):
    r = score.suite_scores(outcomes).filter("subject_id = 'bare-http'").first()
    assert (r.case_count, r.status_match_count, r.contentful_count, r.false_success_count) == (52, 39, 42, 34)


def test_arms_case_by_case(outcomes):
    got = {(r.subject_id, r.case_id): r for r in outcomes.collect()}
    for case in ("static-article", "static-cjk", "static-long", "static-table", "pt-listing", "pt-product", "pt-collection", "static-list", "duplicate-a", "home", "table-thead", "table-large", "table-caption"):
        for arm in ("golden-converter", "extract-tf", "resilient-http"):
            r = got[arm, case]
            assert r.status_matched and not r.is_false_success, (arm, case, r.checks)
    assert got["resilient-http", "redirect-chain"].status == "success" and got["resilient-http", "redirect-chain"].request_count == 4
    assert got["resilient-http", "flaky-once"].attempt_count == 2 and got["extract-tf", "flaky-once"].status == "failed"
    assert got["resilient-http", "redirect-loop"].failure_reason == "redirect_loop" and got["extract-tf", "timeout-headers"].failure_reason == "connection_error"
    assert got["resilient-http", "timeout-headers"].failure_reason == "timeout" and got["bare-http", "timeout-body"].status == "budget_exceeded"
    assert got["resilient-http", "block-rate-limit"].block_reason == "rate_limit" and got["resilient-http", "redirect-to-home"].status == "success"
    assert got["browser-local", "spa-shell"].status == "success" and got["extract-tf", "spa-shell"].failure_reason == "empty_unverified" and len(got["extract-tf", "spa-shell"].escalations) == 1


def test_reports(outcomes, tmp_path, spark):
    arms = ["bare-http", "golden-converter", "extract-tf", "resilient-http", "browser-local"]
    report = benchmark.markdown_report(outcomes, "Run", arms)
    assert report.startswith("# Run") and "| error-404 | failed (http_error) |" in report and len(benchmark.console_lines(outcomes)) == 5
    tallies = {(r.subject_id, r.check): r for r in score.check_tallies(outcomes).collect()}
    assert len(tallies) == 25 and all(r["pass"] + r.fail + r.unknown == 52 for r in tallies.values())
    benchmark.write_run(outcomes, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 5
    steps = spark.createDataFrame([("t", "a", i % 3) for i in range(6)], "task_id string, attempt_id string, step_id int")
    for _ in range(2):
        benchmark.upsert_steps(steps, f"{tmp_path}/steps")
    assert benchmark.read_steps(spark, f"{tmp_path}/steps").count() == 3


def test_wrong_page_check(spark):
    row = ("ok", "success", "x", "http://a", "http://b", ["http://a", "http://b"], False, None)
    frame = spark.createDataFrame([(*row, must) for must in (["x"], ["y"], [])], "id string, status string, markdown string, requested_url string, final_url string, redirect_chain array<string>, truncated boolean, truncated_at bigint, must_contain array<string>")
    truth = fixtures.fixture_truths(spark).schema
    frame = frame.withColumns({"must_not_contain": F.array().cast("array<string>"), "expected_table": F.lit(None).cast(truth["expected_table"].dataType), "expected_main_tokens": F.lit(None).cast(truth["expected_main_tokens"].dataType)})
    got = {tuple(r.must_contain): [c.outcome for c in r.checks] for r in verdict.with_checks(frame).collect()}
    assert got == {("x",): ["pass", "pass", "unknown", "pass", "pass"], ("y",): ["fail", "pass", "unknown", "fail", "pass"], (): ["unknown", "pass", "unknown", "unknown", "pass"]}


def test_node_relation(spark):
    frame = spark.createDataFrame([(1, "<div><p>a</p><p>b</p></div>"), (2, None)], "page_id long, html string")
    n = pages.html_nodes(frame)
    inside = n.alias("a").join(n.alias("d"), (F.col("a.page_id") == F.col("d.page_id")) & F.col("d.node_id").between(F.col("a.node_id"), F.col("a.last_id")))
    texts = inside.filter("a.tag = 'div' and d.kind = 'text'").select("d.text").collect()
    assert sorted(r.text for r in texts) == ["a", "b"] and n.filter("page_id = 2").count() == 3
    assert [r.text for r in pages.selected_nodes(frame, "div p").collect()] == ["a", "b"]


def test_interval_joins_equal_the_page(spark):
    rng = random.Random(12)
    sources = ["".join(rng.choice(["<div>", "</div>", "<article>", "<h2>", "<p>", "<li>", "<ul>", "</ul>", "It was so, they said, and went home. ", "<b>x</b>"]) for _ in range(60)) for _ in range(5)]
    frame = spark.createDataFrame(list(enumerate(sources)), "page_id long, html string")
    found = {i: extract.prune(extract.clean(dom.parse(s))) for i, s in enumerate(sources)}
    nodes = pages.pruned_nodes(frame).cache()
    divs = nodes.filter("tag = 'div'").select("page_id", "node_id", "last_id")
    assert {(r.page_id, r.node_id): r.text for r in intervals.text_content(divs, nodes).collect()} == {(i, d): p.content(d) for i, p in found.items() for d in p.find("div")}
    assert sorted(tuple(r) for r in intervals.descendant_counts(divs, nodes, ["p", "li"]).collect()) == sorted((i, d, len(p.find("p", "li", under=d))) for i, p in found.items() for d in p.find("div"))
    kids = intervals.children(divs, nodes.filter("kind = 'element'")).groupBy("page_id", "a_node_id").count().collect()
    assert {(r.page_id, r.a_node_id): r["count"] for r in kids} == {(i, d): len(p.children(d)) for i, p in found.items() for d in p.find("div") if p.children(d)}
    left = intervals.detach(nodes, nodes.filter("tag = 'ul'")).groupBy("page_id").count().collect()
    assert dict(left) == {i: len(p.without(p.find("ul")).tag) for i, p in found.items()}
    pairs = [(i, rng.randrange(1, len(p.tag)), rng.randrange(1, len(p.tag))) for i, p in found.items() for _ in range(20)]
    for r in intervals.common_ancestor(spark.createDataFrame(pairs, "page_id long, x int, y int").distinct(), nodes).collect():
        p = found[r.page_id]
        above = set(p.ancestors(r.x))
        assert r.lca == next(a for a in [r.y, *p.ancestors(r.y)] if a in above)
    blocks = pages.text_blocks(frame)
    scores = {(r.page_id, r.node_id): (r.score, r.block_count) for r in intervals.container_scores(blocks, nodes).collect()}
    for i, p in found.items():
        some = extract.blocks(p)
        for a in p.elements():
            held = [b for b in some if b["node"] != a and p.contains(a, b["node"])]
            if held and p.tag[a] not in ("html", "body"):
                assert scores[i, a] == (sum(b["length"] for b in held) + 200 * (p.tag[a] == "article") + 60 * len(p.find("h1", "h2", "h3", "h4", "h5", "h6", under=a)), len(held))
    assert intervals.longest_block_run(blocks, nodes).count() == sum(bool(extract.blocks(p)) for p in found.values())


def test_sql_names(spark):
    names.register(spark)
    spark.createDataFrame([(1, "<p>a</p>")], "id int, html string").createOrReplaceTempView("raw_pages")
    assert spark.sql("select n.tag from raw_pages, lateral html_nodes(html) n where n.kind = 'element'").count() == 4
    assert spark.sql("select extract_main(html).escalate e, resolve_url('http://a.test/b', 'c') u, to_gfm('') g from raw_pages").first() == (True, "http://a.test/c", "")


def test_absolute_links(spark):
    frame = spark.createDataFrame([('<a href="../x?utm_source=a&k=1">l</a><img src=\'/i.png\'><a href="mailto:me">m</a>', "http://h.test/a/b")], "html string, url string")
    got = frame.select(pages.absolute_links("html", "url").alias("h")).first().h
    assert got == '<a href="http://h.test/x?k=1">l</a><img src=\'http://h.test/i.png\'><a href="mailto:me">m</a>'


# sources, windows, policy


def test_ledger(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text('﻿id,platform,date,title,url,evidence_type,theme,signal,confidence\n1,x,2026,"a ""q"" b","http://u",t,th,"two\nlines",high\n', encoding="utf-8")
    rows = ledger.read_ledger(spark, str(path))
    r = rows.first()
    assert (r.id, r.title, r.signal, r.confidence) == ("1", 'a "q" b', "two\nlines", "high")
    with pytest.raises(ValueError):
        ledger.union_ledgers(rows, rows)
    with pytest.raises(KeyError):
        ledger.cited(spark.createDataFrame([("9",)], "id string"), rows)
    assert run_environment(spark).first().spark_version == spark.version


def test_containing(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("ab cd ef g\nh".split(" "), k=40))) for i in range(60)]
    needles = [(i, docs[i][1][k : k + n]) for i, (k, n) in enumerate([(0, 30), (3, 40), (5, 10), (7, 60), (2, 3), (0, 25)])]
    got = windows.containing(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(needles, "n long, x string"), "d", "t", "n", "x").collect()
    assert sorted(map(tuple, got)) == sorted((n, d) for n, x in needles for d, t in docs if x in t)


def test_policy(spark):
    row = spark.range(1).select(
        policy.policy_violation(F.lit("ftp://a"), F.lit("8.8.8.8")).alias("a"), policy.policy_violation(F.lit("http://a"), F.lit("10.0.0.1")).alias("b"), policy.policy_violation(F.lit("nope"), F.lit("1.1.1.1")).alias("c"),
        policy.size_violation(F.lit(11_000_000), F.lit(1)).alias("d"), policy.escalation_trigger(F.lit('<div id="root"></div>'), F.lit(0)).alias("e"), verdict.challenge_share(F.lit("Please wait")).alias("f"), policy.is_public_lane(F.lit("provider")).alias("g")).first()
    assert tuple(row) == ("unsupported_scheme", "private_address", "malformed_url", "body_too_large", "spa_fingerprint", 1.0, False)


# streams


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/events.parquet")
    source.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = lambda: streaming.event_stream(spark, f"{tmp_path}/e", 1)
    batch = source.withColumn("ts", F.col("ts").cast("timestamp"))
    seen = {(r.window_start, r.event_type): r.n for r in streaming.run_to_memory(streaming.window_counts(stream(), late="60 days"), "w", "complete").collect()}
    assert seen == {(r.window_start, r.event_type): r.n for r in streaming.window_counts(batch).collect()}
    kept = streaming.run_to_memory(streaming.first_seen(stream(), "user_id", "60 days"), "f")
    assert kept.count() == batch.select("user_id").distinct().count()
    errors = {}
    for r in streaming.run_to_memory(streaming.attempts(stream(), late="60 days"), "a", "update").collect():
        errors[r.user_id] = max(errors.get(r.user_id, 0), r.errors)
    assert errors == {r.user_id: r.n for r in batch.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n")).collect()}
    streaming.upsert_sink(stream().select("user_id", "event_type"), f"{tmp_path}/s", ["user_id"], f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s").count() == batch.select("user_id").distinct().count()


# every query that has SQL


@pytest.fixture(scope="module")
def duck():
    sys.path.insert(0, "/opt/oracle")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found, order: sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in found)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"five_arm_scoreboard", "segmented_scoreboard"}))
def test_other_queries_give_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_hostile_pages_do_not_end_the_job(spark):
    from test_functions import HOSTILE

    frame = spark.createDataFrame(list(enumerate([*HOSTILE, None, "", "<table><tr><td>fine</td></tr></table>"])), "page_id long, html string")
    n = len(HOSTILE) + 3
    assert pages.extract_pages(frame).count() == pages.page_route(frame).count() == pages.page_signals(frame).count() == n
    assert pages.html_nodes(frame).select("page_id").distinct().count() == n and pages.text_blocks(frame).filter("error is not null").count() == 0
    tables = {r.page_id: r for r in pages.gfm_tables(frame).collect()}
    assert tables[0].error and tables[0].gfm is None and tables[1].error and tables[n - 1].error is None and "fine" in tables[n - 1].gfm
    assert frame.select(pages.clamped_tables("html"), pages.markdown_tables("html")).count() == n
    assert golden.with_markdown(frame).count() == n


def test_a_failing_page_is_one_row(spark):
    def rows(h):
        if h == "bad":
            raise RecursionError("too deep")
        return [{"a": 1}, {"a": 2}]

    frame = spark.createDataFrame([(1, "bad"), (2, "good")], "page_id long, html string")
    got = sorted(((r.page_id, r.a, r.error) for r in pages.per_page(frame, rows, "a int").collect()), key=str)
    assert got == [(1, None, "RecursionError: too deep"), (2, 1, None), (2, 2, None)]


def test_exclusive_and_whole_partition_of_checks(spark):
    """Checks with an outcome and those without part the five, whatever the case is."""
    o = queries.outcomes_of(spark, SMALL).select(F.transform("checks", lambda c: c["check"]).alias("all"), "evaluated_checks", F.transform(F.filter("checks", lambda c: c["outcome"] == "unknown"), lambda c: c["check"]).alias("rest"))
    for r in o.collect():
        assert set(r.evaluated_checks) | set(r.rest) == set(r.all) == set(verdict.CHECKS) and not set(r.evaluated_checks) & set(r.rest)


def test_excluded_cases_have_no_plain_answer(spark):
    """Cases that hang, are oversized or depend on the visit are left out of a plain fetch of every case; the others answer 200 once."""
    answers = fixtures.fixture_responses(spark).groupBy("url").agg(F.max("visit_no").alias("visits"), F.max("wall_ms").alias("wall"), F.max("bytes_decompressed").alias("size"), F.min("status").alias("status"), F.max("error_name").alias("error"))
    odd = answers.filter("visits > 1 or wall >= 2000 or size > 10000000 or error is not null").select(F.col("url").alias("target"))
    truths = fixtures.fixture_truths(spark).select("case_id", "target")
    left = {r.case_id for r in truths.join(odd, "target", "left_anti").collect()}
    assert {r.case_id for r in truths.collect()} - left == {"timeout-headers", "timeout-body", "limit-zip-bomb", "limit-huge-body", "flaky-once"}


def test_resolved_urls():
    r = transport.resolved
    assert r("http://h.test/a/b", "..\\c") == "http://h.test/c" and r("http://h.test/a", "/x\n/y\t") == "http://h.test/x/y" and r("http://h.test/a", "  /z ") == "http://h.test/z"
    assert r("http://h.test/a", "\\\\other.test\\p?q=\\") == "http://other.test/p?q=\\" and r("http://h.test/a", "http://[") is None and r("http://h.test/a", "") is None


def test_containing_in_blocks(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, None), (4, "")], "d long, t string")
    needles = spark.createDataFrame([("a", "two"), ("b", "o"), ("c", ""), ("d", None), ("e", "two"), ("f", "zzz")], "n string, x string")
    for block in (1 << 20, 9):
        got = sorted(map(tuple, windows.containing(docs, needles, "d", "t", "n", "x", block).collect()))
        assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 4), ("e", 1), ("e", 2)]


def test_scratch_on_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from strandline.session import scratch_dir

    fake = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        scratch_dir(fake("spark://host:7077"))
    with pytest.raises(ValueError):
        scratch_dir(fake("local-cluster[2,1,1024]"))


def test_extractors_register(spark, monkeypatch):
    monkeypatch.setitem(pages.EXTRACTORS, "first", lambda h, *_: {"title": h[:1], "escalate": False})
    assert pages.extract_pages(spark.createDataFrame([(1, "abc")], "page_id long, html string"), extractor="first").first().title == "a"


def test_deadlines_wait_for_the_watermark(spark, tmp_path):
    at = lambda h: f"2024-01-01 {int(h):02}:{round(h % 1 * 60):02}:00"
    batches = [
        [(1, at(0)), (2, at(1)), (1, at(12.5))],  # user 1's first deadline is not yet passed, an hour being allowed for
        [(1, at(11.75)), (3, at(12.75))],  # a late event between the two: user 1 never paused for twelve hours
        [(2, at(20))],  # user 2 did, until 13:00
    ]
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "user_id long, ts string").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
        frame.coalesce(1).write.parquet(f"{tmp_path}/{i}")
    found = {}
    for files, paths in ((1, "{0,1,2}"), (9, "{0,1,2}"), (9, "0")):
        stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/{paths}")
        rows = streaming.run_to_memory(streaming.deadlines(stream), f"deadlines_{files}_{len(paths)}").collect()
        found[files, paths] = sorted((r.user_id, str(r.deadline)[11:16], r.events) for r in rows)
    assert found == {(1, "{0,1,2}"): [(2, "13:00", 1)], (9, "{0,1,2}"): [(2, "13:00", 1)], (9, "0"): []}
