"""Page operators: one Arrow pass over (id, html) each, all columns but these two pruned from the scan.

Every page is decided inside its task, so none of them shuffles; a page's cost is its own size. No page ends the job: what
fails is one row whose column `error` says why, and whose other columns are null. Pages that come in fewer pieces than there are
cores are dealt out first, as parsing costs far more than moving them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import dom, extract, gfm

#: Rows of a batch that are parsed before they are handed on.
ROWS = 256
#: Bytes for each core below which pages are dealt out.
PIECE = 64 << 20


def spread(pages: DataFrame) -> DataFrame:
    """The rows dealt over all cores if the plan's estimate of their size says that they may lie in fewer pieces."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.isStreaming or int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * PIECE:
        return pages
    return pages.repartition(cores)


def per_page(pages: DataFrame, rows_of: Callable[[str | None], list[dict]], schema: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, the rows that rows_of makes of each page, and error, which is null unless the page failed."""
    kind = pages.schema[key].dataType.simpleString()
    schema += ", error string"
    shape = StructType.fromDDL(schema)
    names = shape.names
    failed = dict.fromkeys(names)

    def rows_or_error(html: str | None) -> list[dict]:
        try:
            return rows_of(html)
        except Exception as e:  # a page is input: whatever it makes a parser do, it is one row of the result
            return [failed | {"error": f"{type(e).__name__}: {e}"[:500]}]
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [rows_or_error(x.as_py()) for x in part.column(1)]
                ids = part.column(0).take(pa.array([i for i, r in enumerate(found) for _ in r], pa.int64()))
                columns = [pa.array([x.get(n) for r in found for x in r], arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=[key, *names])

    return spread(pages.select(key, html)).mapInArrow(run, f"`{key}` {kind}, {schema}")


NODES = "node_id int, last_id int, parent_id int, depth int, kind string, tag string, id_attr string, class_attr string, aria_label string, attrs map<string,string>, text string"


def _nodes(page: dom.Page) -> list[dict]:
    return [
        {"node_id": i, "last_id": page.last[i], "parent_id": page.parent[i], "depth": page.depth[i], "kind": page.kind[i], "tag": page.tag[i], "id_attr": a.get("id"), "class_attr": a.get("class"),
         "aria_label": a.get("aria-label"), "attrs": list(a.items()), "text": page.text[i]}
        for i, a in enumerate(page.attrs)
    ]


def html_nodes(pages: DataFrame, **columns: str) -> DataFrame:
    """The page as a relation: a row for each node; i is inside j iff node_id(j) <= node_id(i) <= last_id(j)."""
    return per_page(pages, lambda h: _nodes(dom.parse(h)), NODES, **columns)


def pruned_nodes(pages: DataFrame, selectors: tuple[str, ...] = (), **columns: str) -> DataFrame:
    """The nodes that cleaning and pruning leave."""
    return per_page(pages, lambda h: _nodes(extract.prune(extract.clean(dom.parse(h)), selectors)), NODES, **columns)


def selected_nodes(pages: DataFrame, selector: str, **columns: str) -> DataFrame:
    """node_id, tag, text content and HTML of each element that matches the selector."""

    def rows(h: str | None) -> list[dict]:
        page = dom.parse(h)
        return [{"node_id": i, "tag": page.tag[i], "text": page.content(i), "html": page.serialise(i)} for i in dom.select(page, selector)]

    return per_page(pages, rows, "node_id int, tag string, text string, html string", **columns)


def page_signals(pages: DataFrame, **columns: str) -> DataFrame:
    return per_page(pages, lambda h: [extract.signals(dom.parse(h))], "jsonld array<string>, itemprop array<string>, itemtype array<string>, posts int", **columns)


ROUTE = "page_type string, strategy string, li int, a int, `table` int, table_in_article int, article int, main int, headings int, text_chars int, link_density double"


def page_route(pages: DataFrame, **columns: str) -> DataFrame:
    def rows(h: str | None) -> list[dict]:
        page = dom.parse(h)
        found = extract.signals(page)
        n = extract.counts(extract.prune(extract.clean(page)))
        kind, strategy = extract.route(n, found)
        return [{"page_type": kind, "strategy": strategy, **n}]

    return per_page(pages, rows, ROUTE, **columns)


def text_blocks(pages: DataFrame, favor_precision: bool = False, **columns: str) -> DataFrame:
    def rows(h: str | None) -> list[dict]:
        page = extract.prune(extract.clean(dom.parse(h)))
        return extract.blocks(page, extract.MIN_TEXT_PRECISE if favor_precision else extract.MIN_TEXT, favor_precision)

    return per_page(pages, rows, "node int, text string, length int, link_density double", **columns)


EXTRACTED = "title string, main_html string, confidence double, escalate boolean, page_type string, strategy string, n_blocks int, n_main_blocks int"


#: Extractors by name: functions (html, favor_precision, favor_recall, prune_selectors) -> a row of EXTRACTED as a dictionary.
EXTRACTORS: dict[str, Callable[..., dict]] = {"cascade": extract.extract}


def extract_pages(pages: DataFrame, favor_precision: bool = False, favor_recall: bool = False, prune_selectors: tuple[str, ...] = (), extractor: str = "cascade", **columns: str) -> DataFrame:
    """The main content of each page, by the extractor registered under that name."""
    found = EXTRACTORS[extractor]
    return per_page(pages, lambda h: [found(h, favor_precision, favor_recall, prune_selectors)], EXTRACTED, **columns)


def minimal_headings(pages: DataFrame, **columns: str) -> DataFrame:
    """The page's first heading, for callers that want a small result."""

    def rows(h: str | None) -> list[dict]:
        page = dom.parse(h)
        at = extract.minimal(page)
        return [] if at is None else [{"tag": page.tag[at], "text": page.content(at).strip()}]

    return per_page(pages, rows, "tag string, text string", **columns)


def gfm_tables(pages: DataFrame, **columns: str) -> DataFrame:
    """Each table of a page's source as a logical grid and as GFM text; of a table that is too large, its number and the error."""

    def row(i: int, t: str) -> dict:
        try:
            return {"nth": i, "grid": gfm.grid_of(t), "gfm": gfm.to_gfm(t)}
        except gfm.TooLarge as e:
            return {"nth": i, "error": str(e)}

    def rows(h: str | None) -> list[dict]:
        return [row(i, t) for i, t in enumerate(gfm.TABLE.findall(h or ""))]

    return per_page(pages, rows, "nth int, grid array<array<string>>, gfm string", **columns)


def of_each(values: pd.Series, f: Callable[[str], str]) -> pd.Series:
    return pd.Series([None if v is None else f(v) for v in values], dtype=object)


@F.pandas_udf(T.StringType())
def markdown_tables(html: pd.Series) -> pd.Series:
    """The HTML with each table replaced by its GFM text."""
    return of_each(html, gfm.with_tables)


@F.pandas_udf(T.StringType())
def clamped_tables(html: pd.Series) -> pd.Series:
    return of_each(html, lambda h: gfm.with_tables(gfm.clamp_spans(h)))


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def expected_table_issues(markdown: str | None, columns: int | None, rows: int | None, cells, same_row, same_column, require: bool | None):
    """What the text's first table lacks of the expected one; null without an expectation or text."""
    if columns is None or markdown is None:
        return None
    spec = {"columns": columns, "rows": rows, "cells": dict(cells or {}), "same_row": list(same_row or []), "same_column": list(same_column or []), "require_markdown": require}
    return gfm.table_issues(markdown, spec)


_LINK = re.compile(r"""(\b(?:href|src)\s*=\s*)(["'])(.*?)\2""", re.I | re.S)
_TRACKING = re.compile("utm_[a-z]+|gclid|fbclid|ref")


def _clean_link(base: str, link: str) -> str:
    try:
        parts = urlsplit(urljoin(base, link.strip()))
    except ValueError:
        return link
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not _TRACKING.fullmatch(k)]
    return parts._replace(query=urlencode(kept)).geturl() if parts.scheme in ("http", "https") else link


@F.pandas_udf(T.StringType())
def absolute_links(html: pd.Series, base: pd.Series) -> pd.Series:
    """The HTML with its links made absolute and freed of tracking parameters."""
    return pd.Series([h if h is None or b is None else _LINK.sub(lambda m, b=b: f"{m[1]}{m[2]}{_clean_link(b, m[3])}{m[2]}", h) for h, b in zip(html, base, strict=True)], dtype=object)
