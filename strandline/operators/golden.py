"""The reference converter as a chain of built-in expressions: main or article, tables, headings, items, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

ANY = r"[\s\S]*?"


def main_html(html: Column) -> Column:
    """The first main, else the first article, else all but consent boxes, navigation, asides and footers."""
    main, article = (F.regexp_substr(html, F.lit(rf"(?i)<{tag}\b{ANY}</{tag}>")) for tag in ("main", "article"))
    rest = F.regexp_replace(html, rf'(?i)<div[^>]*id="cookie-consent"{ANY}</div>', "")
    rest = F.regexp_replace(rest, rf"(?i)<(?:nav|aside|footer)\b{ANY}</(?:nav|aside|footer)>", "")
    return F.coalesce(main, article, rest)


def strip_tags(html: Column) -> Column:
    """Headings, items and paragraphs get their marks; a heading or item inside another is seen once the outer is done."""
    for level in range(1, 7):
        html = F.regexp_replace(html, rf"(?i)<h{level}\b[^>]*>({ANY})</h{level}>", "\n" + "#" * level + " $1\n")
    html = F.regexp_replace(html, rf"(?i)<li\b[^>]*>({ANY})</li>", "\n- $1")
    html = F.regexp_replace(html, rf"(?i)<p\b[^>]*>({ANY})</p>", "\n$1\n")
    return F.regexp_replace(html, "<[^>]+>", "")


def tidy(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def golden_markdown(html: Column) -> Column:
    """The converter for HTML that may hold tables: all of it goes through the table converter's worker."""
    from .pages import clamped_tables

    return tidy(strip_tags(clamped_tables(main_html(html))))


def with_markdown(rows: DataFrame, html: str = "html", out: str = "markdown") -> DataFrame:
    """rows with their HTML's text. Only rows with a table go to a worker; the others stay in generated code."""
    from .pages import spread

    rows = spread(rows)
    tabled = F.coalesce(F.col(html).rlike(r"(?i)<table\b"), F.lit(False))
    plain = rows.filter(~tabled).withColumn(out, tidy(strip_tags(main_html(F.col(html)))))
    return plain.unionByName(rows.filter(tabled).withColumn(out, golden_markdown(F.col(html))))
