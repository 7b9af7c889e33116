"""Main content of one page: signals, pruning, routing, block selection. Pure functions of a page's rows.

They run inside one Arrow pass over the pages, so a page never leaves its task and nothing is shuffled."""

from __future__ import annotations

import json
import math
import re

from . import dom
from .dom import Page
from .js import SPACE, is_cjk, looks_prose, squeeze, strip, units

# Tags and tokens that never hold main content.
CLEANED = tuple("script style noscript iframe frame object embed applet aside nav footer form dialog button select textarea input canvas svg template".split())
CONSENT_IDS = frozenset("cookie consent gdpr cmp ccpa onetrust didomi usercentrics cookiebot trustarc sourcepoint".split())
CONSENT_CLASSES = frozenset({"interstitial"})
AD_TOKENS = frozenset("ad ads advert advertisement sponsored promo".split())
# Block tags, product properties and thresholds.
BLOCK_TAGS = tuple("p h1 h2 h3 h4 h5 h6 li td th blockquote pre".split())
STRUCTURAL = frozenset({"td", "th", "li"})
PRODUCT_PROPS = frozenset("price offers sku gtin mpn brand".split())
MIN_TEXT, MIN_TEXT_PRECISE, MIN_TEXT_RECALL, MIN_CJK, MIN_CELL, MIN_CELL_PRECISE, MAX_DENSITY = 25, 60, 15, 8, 5, 12, 0.2


def tokens(value: str) -> set[str]:
    return set(re.split(r"[_-]+", SPACE.sub("_", value.lower())))


def signals(page: Page) -> dict:
    """JSON-LD types, itemprop and itemtype tokens, and posts, of a page as it came."""
    types: list[str] = []

    def walk(x) -> None:
        if isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            kinds = x.get("@type")
            types.extend(k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str))
            for y in x.values():
                walk(y)

    out = {"jsonld": [], "itemprop": [], "itemtype": [], "posts": 0}
    for i in page.elements():
        attrs = page.attrs[i]
        if page.tag[i] == "script" and attrs.get("type", "").strip().lower() == "application/ld+json":
            try:
                walk(json.loads(page.content(i)))
            except (ValueError, RecursionError):  # not JSON, or nested beyond any real page's depth
                pass
        if "itemprop" in attrs:
            out["itemprop"] += [t for t in re.split(r"[\t\n\f\r ]+", attrs["itemprop"].lower()) if t]
        if "itemtype" in attrs:
            out["itemtype"] += [type_name(t) for t in re.split(r"[\t\n\f\r ]+", attrs["itemtype"]) if t]
        if page.tag[i] == "article" and "post" in attrs.get("class", "").split():
            out["posts"] += 1
    out["jsonld"] = [type_name(t) for t in types]
    return out


def type_name(value: str) -> str:
    """The last part of a type's name: what stands after its last slash or hash, if anything does, else what stands after a prefix's colon."""
    value = strip(value)
    tail = re.split(r"[/#]", value)[-1]
    return (tail if tail and tail != value else value.split(":", 1)[-1]).lower()


def clean(page: Page) -> Page:
    return page.without(page.find(*CLEANED))


def prune(page: Page, selectors: tuple[str, ...] = ()) -> Page:
    """Less consent banners, ads, small link farms and what the caller's selectors match."""
    roots = []
    for i in page.elements():
        attrs = page.attrs[i]
        if "id" not in attrs and "class" not in attrs:
            continue
        ids, classes = tokens(attrs.get("id", "")), tokens(attrs.get("class", ""))
        hint = re.search("cookie|consent|gdpr", attrs.get("aria-label", "").lower())
        if ids & (CONSENT_IDS | AD_TOKENS) or classes & (CONSENT_CLASSES | AD_TOKENS) or hint:
            roots.append(i)
    page = page.without(roots)
    farms = []
    for i in page.find("div", "section", "li"):
        name = page.attrs[i].get("class", "") + page.attrs[i].get("id", "")
        if re.search("ad|sponsor|promo|partner", name, re.I) and page.count("a", under=i) >= 3 and 0 < units(strip(page.content(i))) < 40:
            farms.append(i)
    page = page.without(farms)
    for s in selectors:
        page = page.without(dom.select(page, s))
    return page


def counts(page: Page) -> dict:
    body = page.body()
    chars = units(strip(squeeze(page.content(body)))) if body is not None else 0
    links, articles, tables = len(page.find("a")), page.find("article"), page.find("table")
    return {
        "li": len(page.find("li")), "a": links, "table": len(tables), "table_in_article": sum(any(page.contains(a, t) for a in articles) for t in tables),
        "article": len(articles), "main": len(page.find("main")), "headings": len(page.find("h1", "h2", "h3")), "text_chars": chars, "link_density": links / chars * 100 if chars else 0.0,
    }


def route(n: dict, s: dict) -> tuple[str, str]:
    """(page type, strategy): the first rule that holds."""
    jsonld, props, types = set(s["jsonld"]), set(s["itemprop"]), set(s["itemtype"])
    product = "product" in jsonld | types or props & {"product", "offer"} or len(props & PRODUCT_PROPS) >= 2
    free = n["table_in_article"] == 0
    rules = [
        (product, "product", "table" if free and n["table"] >= 1 else "article"),
        ("offercatalog" in jsonld | types, "collection", "article"),
        (s["posts"] >= 2 or "discussionforumposting" in jsonld or "forum" in jsonld | types, "forum", "article"),
        (free and n["table"] == 1 and n["li"] < 10 and n["a"] < 20 and n["headings"] <= 2, "collection", "table"),
        (free and n["table"] >= 2 and n["li"] < 15, "collection", "table"),
        (n["li"] >= 6 and n["a"] >= 6 and n["text_chars"] < 2000, "listing", "list"),
        (n["a"] >= 15 and n["link_density"] >= 2 and not n["table"] and not n["article"], "listing", "list"),
        (n["li"] >= 4 and n["a"] >= 4 and n["text_chars"] < 2000, "collection", "article"),
        (n["text_chars"] > 3000 and n["headings"] >= 5 and n["a"] >= 20, "collection", "article"),
    ]
    return next(((kind, strategy) for holds, kind, strategy in rules if holds), ("article", "article"))


def blocks(page: Page, least: int = MIN_TEXT, precise: bool = False) -> list[dict]:
    """Text blocks that are long enough, not mostly links, and prose unless they are cells or items."""
    out = []
    for i in page.find(*BLOCK_TAGS):
        text = squeeze(page.content(i))
        structural = page.tag[i] in STRUCTURAL
        floor = MIN_CJK if is_cjk(text) else (MIN_CELL_PRECISE if precise else MIN_CELL) if structural else least
        if not text or units(text) < floor:
            continue
        density = units(squeeze(" ".join(page.content(a) for a in page.find("a", under=i)))) / units(text)
        if density <= MAX_DENSITY and (structural or looks_prose(text)):
            out.append({"node": i, "text": text, "length": units(text), "link_density": density})
    return out


def main_of_article(page: Page, found: list[dict]) -> int | None:
    """The first article or main with half of the blocks; else the best scored container if it leads; else the longest run's parent."""
    if not found:
        return None
    for tag in ("article", "main"):
        for i in page.find(tag)[:1]:
            if 2 * sum(page.contains(i, b["node"]) for b in found) >= len(found):
                return i
    body, score, size = page.body(), {}, {}
    for b in found:
        for a in page.ancestors(b["node"]):
            if a in (body, 0):
                break
            score[a] = score.get(a, 0) + b["length"]
            size[a] = size.get(a, 0) + 1
    for a in score:
        score[a] += 200 * (page.tag[a] in ("article", "main")) + 60 * page.count("h1", "h2", "h3", "h4", "h5", "h6", under=a)
    ranked = sorted(score, key=lambda a: -score[a])  # stable: equal scores stay as first met
    if not ranked:
        return None
    best, second = ranked[0], score[ranked[1]] if len(ranked) > 1 else 0
    if 2 * size[best] >= len(found) or not second or score[best] >= 1.4 * second:
        return best
    runs: list[list[int]] = []
    for b in found:
        p = page.parent[b["node"]]
        if runs and runs[-1][0] == p:
            runs[-1][1] += 1
        else:
            runs.append([p, 1])
    return max(runs, key=lambda r: r[1])[0]


def main_of_list(page: Page) -> int | None:
    """The list with the most linked items; else the container with the most linked children, deeper ones first."""
    lists = []
    for i in page.find("ul", "ol"):
        items = [c for c in page.children(i) if page.tag[c] == "li"]
        linked = sum(page.count("a", under=c) > 0 for c in items)
        if linked >= 3 and linked >= 0.6 * len(items):
            lists.append((linked, -i))
    if lists:
        return -max(lists)[1]
    boxes = [(linked, page.depth[i], -i) for i in page.find("div", "section") if (linked := sum(page.count("a", under=c) > 0 for c in page.children(i))) >= 3]
    return -max(boxes)[2] if boxes else None


def main_of_table(page: Page) -> int | None:
    """The largest data table, or what holds it together with the page's one heading."""
    cells = {t: page.count("td", "th", under=t) for t in page.find("table") if page.count("tr", under=t) >= 2}
    data = [t for t in cells if cells[t] >= 4]
    if not data:
        return None
    table = max(data, key=lambda t: (cells[t], -t))
    heads = page.find("h1")
    if len(heads) == 1 and not page.contains(table, heads[0]):
        above = set(page.ancestors(table))
        shared = next((a for a in [heads[0], *page.ancestors(heads[0])] if a in above), None)
        if shared not in (None, 0, page.body()):
            return shared
    return table


def minimal(page: Page) -> int | None:
    """The first h1, else the first h2 or h3."""
    return next(iter(page.find("h1") or page.find("h2", "h3")), None)


def title_of(page: Page, main: int | None) -> str | None:
    for h in page.find("h1", under=main)[:1] if main is not None else []:
        if text := strip(page.content(h)):
            return text
    return next((strip(page.content(t)) for t in page.find("title")), None)


def extract(source: str | None, favor_precision: bool = False, favor_recall: bool = False, selectors: tuple[str, ...] = ()) -> dict:
    page = dom.parse(source)
    found = signals(page)
    page = prune(clean(page), tuple(selectors))
    kind, strategy = route(counts(page), found)
    least = MIN_TEXT_RECALL if favor_recall else MIN_TEXT_PRECISE if favor_precision else MIN_TEXT
    some = blocks(page, least, favor_precision)
    main = {"list": main_of_list, "table": main_of_table}[strategy](page) if strategy != "article" else main_of_article(page, some)
    inside = sum(page.contains(main, b["node"]) for b in some) if main is not None else 0
    conf = inside / len(some) if some else 0.0
    if main is not None and page.tag[main] in ("article", "main"):
        conf = min(1.0, conf + 0.15)
    if main is None or units(page.content(main)) < 80:
        conf = min(conf, 0.4)
    if kind != "article":
        conf = min(conf, 0.75)
    if favor_precision:
        conf = min(conf, 0.85)
    if favor_recall:
        conf = max(conf, 0.3)
    return {
        "title": title_of(page, main), "main_html": page.serialise(main) if main is not None else "", "confidence": math.floor(conf * 100 + 0.5) / 100,
        "escalate": main is None, "page_type": kind, "strategy": strategy, "n_blocks": len(some), "n_main_blocks": inside,
    }
