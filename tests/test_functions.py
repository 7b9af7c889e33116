"""Pure functions: pages as rows, pruning, routing, selection, tables."""

import random

import pytest

from strandline.functions import dom, extract, gfm, js

TEXT = "The ferry was late again, and nobody on the pier knew why it had not left."


def page(body, head=""):
    return f"<html><head><title> T </title>{head}</head><body>{body}</body></html>"


def framed(body):
    return page(f'<div id="cookie-consent">We keep small files.</div><nav><a href="/">Home link</a></nav>{body}<aside>Other links</aside><footer>Imprint</footer>')


# pages as rows


def test_parse_orders_rows_by_intervals():
    p = dom.parse("<div><p>one<p>two<b>three</div>tail<ul><li>x<li>y</ul>")
    assert [p.tag[i] for i in p.elements()] == ["html", "head", "body", "div", "p", "p", "b", "ul", "li", "li"]
    for i in range(1, len(p.tag)):
        assert p.contains(p.parent[i], i) and p.last[i] <= p.last[p.parent[i]] and p.depth[i] == p.depth[p.parent[i]] + 1
    assert p.content(0) == "onetwothreetailxy"


@pytest.mark.parametrize("source", ["", None, "   ", "<", "<p", "</p></b>", "<!-- x", "text", "<table><tr><td>a<td>b<tr><td>c", "<script>var t='</p>';</script>x"])
def test_parse_takes_anything(source):
    p = dom.parse(source)
    assert p.tag[0] == "html" and p.find("head") and p.body() is not None


def test_containment_equals_walking_up():
    rng = random.Random(2)
    source = "".join(rng.choice(["<div>", "</div>", "<p>", "<li>", "</ul>", "<ul>", "text ", "<b>", "<td>"]) for _ in range(400))
    p = dom.parse(source)
    for _ in range(300):
        a, b = rng.randrange(len(p.tag)), rng.randrange(len(p.tag))
        assert p.contains(a, b) == (a == b or a in p.ancestors(b))


def test_raw_text_and_void_tags_survive_serialising():
    p = dom.parse('<p a="1 &amp; 2">x &lt; y<br><img src=z></p><script>a<b</script>')
    assert p.serialise(p.body()) == '<body><p a="1 &amp; 2">x &lt; y<br><img src="z"></p><script>a<b</script></body>'


def test_select():
    p = dom.parse('<div class="a b" id="k"><p class="x">1</p><section><p>2</p></section></div><p data-r="1">3</p>')
    text = lambda s: [p.content(i) for i in dom.select(p, s)]
    assert text("p") == ["1", "2", "3"] and text("div.a p") == ["1", "2"] and text("#k .x, [data-r]") == ["1", "3"] and text("p[data-r=1]") == ["3"] and text("p:::") == []


# pruning


@pytest.mark.parametrize("attrs, kept", [
    ('id="onetrust-banner-sdk"', False), ('class="cookie-banner"', True), ('class="interstitial"', False), ('id="x" aria-label="Close Cookie bar"', False), ('aria-label="cookie"', True),
    ('class="ad"', False), ('class="adept"', True), ('class="banner-ad"', False), ('class="promo box"', False), ('id="gdpr_note"', False)])
def test_prune_tokens(attrs, kept):
    p = extract.prune(dom.parse(f"<div {attrs}>inside</div><p>out</p>"))
    assert ("inside" in p.content(0)) == kept


def test_prune_link_farms_and_selectors():
    farm = '<div class="partners"><a>a</a><a>b</a><a>c</a></div>'
    assert "abc" not in extract.prune(dom.parse(farm)).content(0)
    assert "abc" in extract.prune(dom.parse(farm.replace("partners", "friends"))).content(0)
    assert extract.prune(dom.parse('<p class="x">gone</p><p>here</p>'), (".x",)).content(0) == "here"


# extraction


def test_extract_article():
    out = extract.extract(framed(f"<article><h1>Ferry</h1><p>{TEXT}</p><p>{TEXT}</p></article>"))
    assert out["title"] == "Ferry" and out["confidence"] == 1.0 and not out["escalate"] and (out["page_type"], out["strategy"]) == ("article", "article")
    assert not any(x in out["main_html"] for x in ("small files", "Home link", "Other links", "Imprint"))


def test_extract_falls_back():
    assert extract.extract(page('<div id="root"></div>'))["escalate"]
    out = extract.extract(page(f"<div><p>{TEXT}</p><p>{TEXT}</p></div>"))
    assert out["main_html"].startswith("<div>") and out["title"] == "T"
    assert extract.extract(page(f"<p>{TEXT}</p>"))["escalate"]  # blocks right under body have no container
    cjk = extract.extract(page("<article><p>灯塔建于一八七一年海边</p><p>守塔人每天走四百级台阶</p></article>"))
    assert not cjk["escalate"] and cjk["n_blocks"] == 2


def test_presets():
    short = "".join(f"<p>A short line, number {i}.</p>" for i in range(3))
    source = page(f"<article>{short}</article><div><p>{TEXT} {TEXT}</p></div>")
    assert extract.extract(source, favor_precision=True)["main_html"].startswith("<div>")
    assert extract.extract(source, favor_recall=True)["main_html"].startswith("<article>")
    assert extract.extract("", favor_recall=True)["confidence"] == 0.3


LINKED = "".join(f'<li><a href="/{i}">Entry {i}</a> with words</li>' for i in range(10))
LD = '<script type="application/ld+json">{}</script>'
ROWS = "<tr><th>Name</th><th>Value</th></tr><tr><td>Weight</td><td>2 kg</td></tr>"


@pytest.mark.parametrize("body, head, want", [
    (f"<ul>{LINKED}</ul>", "", ("listing", "list")),
    (f"<table>{ROWS}</table>", LD.format('{"@type":"Product"}'), ("product", "table")),
    ("<p>x</p>", LD.format('{"@type":["Thing","http://schema.org/Product"]}'), ("product", "article")),
    ("<p>x</p>", LD.format('{"@graph":[{"@type":"schema:Product"}]}'), ("product", "article")),
    (f"<table>{ROWS}</table>", LD.format("{broken"), ("collection", "table")),
    ('<div itemprop="price">1</div><div itemprop="sku">2</div>', "", ("product", "article")),
    ('<div itemprop="priceCurrency">1</div>', "", ("article", "article")),
    ('<div itemprop="brandish"></div>', "", ("article", "article")),
    ("<p>x</p>", LD.format('{"@type":"OfferCatalog"}'), ("collection", "article")),
    ("<p>x</p>", LD.format('{"@type":"DiscussionForumPosting"}'), ("forum", "article")),
    ("<p>x</p>", LD.format('{"@type":"Comment"}'), ("article", "article")),
    ('<article class="post">a</article><article class="post">b</article>', "", ("forum", "article")),
    ('<article class="post">a</article>', "", ("article", "article")),
    (f"<table>{ROWS}</table>" * 2, "", ("collection", "table")),
    ("<h2>A</h2><ul>" + LINKED[: LINKED.index("<li><a href=\"/4")] + "</ul>", "", ("collection", "article")),
    ("".join(f'<div><a href="/{i}">c</a><a href="/{i}">d</a> t</div>' for i in range(10)), "", ("listing", "list"))])
def test_route(body, head, want):
    out = extract.extract(page(body, head))
    assert (out["page_type"], out["strategy"]) == want


def test_list_and_table_strategies():
    p = dom.parse(f"<ul><li>a</li></ul><ol>{LINKED}</ol>")
    assert p.tag[extract.main_of_list(p)] == "ol"
    cards = dom.parse("<section><div>" + '<div><a href="/">x</a></div>' * 4 + "</div></section>")
    assert cards.tag[extract.main_of_list(cards)] == "div"
    t = dom.parse(f"<div><h1>Lamp</h1><table><tr><td>x</td></tr></table><table>{ROWS}</table></div>")
    assert t.tag[extract.main_of_table(t)] == "div"
    assert extract.main_of_table(dom.parse("<table><tr><td>x</td></tr></table>")) is None
    assert extract.minimal(dom.parse("<h2>b</h2><h1>a</h1>")) is not None


# tables


def grid(*rows):
    return gfm.grid_of("<table>" + "".join("<tr>" + "".join(rows_) + "</tr>" for rows_ in rows) + "</table>")


def td(text="", **attrs):
    return "<td" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + f">{text}</td>"


def test_grids():
    assert grid([td("A"), td("B")], [td("1"), td("2")]) == [["A", "B"], ["1", "2"]]
    assert grid([td("S", colspan=3)], [td("A"), td("B"), td("C")]) == [["S", "", ""], ["A", "B", "C"]]
    assert grid([td("T", rowspan=3), td("R1")], [td("R2")], [td("R3")]) == [["T", "R1"], ["", "R2"], ["", "R3"]]
    assert grid([td("O", rowspan=2, colspan=2), td("M")], [td("R")], [td("L"), td(), td()]) == [["O", "", "M"], ["", "", "R"], ["L", "", ""]]
    assert grid([td("a|b")])[0] == [r"a\|b"] and grid([td("A"), td(), td("C")]) == [["A", "", "C"]]
    assert grid([td("x", colspan=0), td("y<br>z &amp;#60;b&amp;#62;")]) == [["x", r"y \| z"]]
    assert gfm.to_gfm("<table></table>") == "" and gfm.to_gfm("<table><caption>C</caption><tr><td></td><td>x</td></tr><tr><td>1</td><td>2</td></tr></table>") == "C\n| (header) | x |\n| --- | --- |\n| 1 | 2 |"
    with pytest.raises(ValueError):
        grid([td("x", colspan=10**7)])
    assert len(gfm.grid_of(gfm.clamp_spans('<table><tr><td colspan="10000">a</td><td>b</td></tr></table>'))[0]) == 5


def test_decode_order():
    assert gfm.decode("&amp;lt; &amp;#60; &#x41;&#66; &nbsp;|") == "&lt; < AB  |"


def test_parse_gfm():
    md = "| A | B |\n| --- | :-: |\n| 1 | 2 |\n| 3 | 4 |"
    assert gfm.parse_gfm(md) == [["A", "B"], ["1", "2"], ["3", "4"]]
    assert gfm.parse_gfm(md.replace("| A", "A", 1)) is not None
    assert gfm.parse_gfm("| A | B |\n| --- | --- |\n| 1 |") is None and gfm.parse_gfm("| A | B |\n| === | --- |\n| 1 | 2 |") is None
    assert gfm.parse_gfm(f"```\n{md}\n```") is None and gfm.parse_gfm(f"~~~\nx\n~~~\n{md}") is not None
    assert gfm.split_row("| `a|b` | c \\| d |") == ["`a|b`", r"c \| d"] and gfm.split_row("none") is None and gfm.split_row("| a ||") == ["a", ""]


def test_table_issues():
    md = "| A | B |\n| --- | --- |\n| x1 | y1 |\n| x2 | y2 |"
    ok = {"columns": 2, "rows": 3, "cells": {"1,0": "x1"}, "same_row": ["x2", "y2"], "same_column": ["y1", "y2"]}
    assert gfm.table_issues(md, ok) == []
    for change in ({"columns": 3}, {"rows": 2}, {"cells": {"1,0": "y1"}}, {"cells": {"9,9": "x"}}, {"cells": {"k": "x"}}, {"same_row": ["x1", "y2"]}, {"same_column": ["x1", "y2"]}, {"same_row": ["zz"]}):
        assert gfm.table_issues(md, ok | change)
    assert gfm.table_issues("prose", ok) and gfm.table_issues("prose", ok | {"require_markdown": False}) == []


def test_js_text_rules():
    assert js.squeeze("﻿ a  \n b　") == "a b" and js.units("a😀") == 3
    assert js.estimate_tokens("") == 0 and js.estimate_tokens("abcde") == 2 and js.estimate_tokens("漢字ab😀") == 3
    assert js.is_cjk("漢字漢字 abc") and not js.is_cjk("漢 abcdefgh")
    assert js.looks_prose("It is so.") and js.looks_prose('He said "no." Then') and not js.looks_prose("no end")


HOSTILE = [
    '<table><tr><td colspan="2000000">wide</td></tr></table>', f'<table><tr><td colspan="{"9" * 5000}">x</td></tr></table>', f'<table><tr><td rowspan="{"9" * 5000}">x</td></tr><tr><td>y</td></tr></table>',
    f"<p>half a pair &#xD800; and &#{'1' * 5000}; beyond</p>", f"<p>{'&#' + '0' * 5000 + '65;'}</p>", '<script type="application/ld+json">' + "[" * 100_000 + "</script><p>after</p>", "<![foo bar]]><p>after it</p>", "<![if", "<!", "</", "<", "\x00", "<div>" * 5000 + "deep",
]


def test_hostile_pages_give_a_page():
    for source in HOSTILE:
        found = extract.extract(source)
        assert found["escalate"] in (True, False)
        gfm.with_tables(gfm.clamp_spans(source))
    assert gfm.decode("&#xD800;&#55296;") == "��" and gfm.decode("&#" + "0" * 5000 + "65;") == "A"
    assert "wide" in gfm.with_tables(HOSTILE[0]) and "| x |" in gfm.with_tables(gfm.clamp_spans(HOSTILE[1]))


def test_select_steps_and_tests():
    p = dom.parse('<div id="a"><p class="x y">1</p><p>2</p><span lang="en-GB">3</span><section><p>4</p><b></b></section></div><p data-k="v w">5</p>')
    texts = lambda s: [p.content(i) for i in dom.select(p, s)]
    assert texts("div > p") == ["1", "2"] and texts("div p") == ["1", "2", "4"] and texts("p + p") == ["2"] and texts("p ~ span") == ["3"] and texts("p + span") == ["3"]
    assert texts("body > p, section>p") == ["4", "5"] and texts(":scope > body > p") == ["5"] and texts("div > :first-child") == ["1"] and texts("div > p:nth-child(2)") == ["2"]
    assert texts("p:not(.x)") == ["2", "4", "5"] and texts("b:empty") == [""] and texts('[lang|="en"]') == ["3"] and texts('[data-k~="w"]') == ["5"] and texts('[data-k^="v"][data-k$="w"][data-k*=" "]') == ["5"]
    assert texts("section :last-child") == [""] and texts("div p:only-child") == [] and texts("p:unknown") == texts("> p") == texts("p >") == texts("") == []


def test_pages_in_any_order_are_put_in_order():
    p = dom.parse("<p>first</p><title>late</title>")
    assert [t for t in p.tag if t][:3] == ["html", "head", "body"] and all(a < b for a, b in zip(p.parent[1:], range(1, 99)))
