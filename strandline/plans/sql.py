"""The engine's functions under names that SQL can use."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dom, extract, gfm
from ..operators import pages, transport
from ..session import ship


class HtmlNodes:
    """SELECT ... FROM pages, LATERAL html_nodes(html)"""

    def eval(self, html: str) -> Iterator[tuple]:
        page = dom.parse(html)
        for i, a in enumerate(page.attrs):
            yield i, page.last[i], page.parent[i], page.depth[i], page.kind[i], page.tag[i], a.get("id"), a.get("class"), page.text[i]


def register(spark: SparkSession) -> None:
    """html_nodes (a table function), extract_main, to_gfm, markdown_tables, absolute_links and resolve_url."""
    ship(spark)
    spark.udtf.register("html_nodes", F.udtf(HtmlNodes, returnType="node_id int, last_id int, parent_id int, depth int, kind string, tag string, id_attr string, class_attr string, text string"))
    shape = "struct<title:string,main_html:string,confidence:double,escalate:boolean,page_type:string,strategy:string>"

    def main(html: str | None):
        found = extract.extract(html)
        return tuple(found[k] for k in ("title", "main_html", "confidence", "escalate", "page_type", "strategy"))

    spark.udf.register("extract_main", F.udf(main, shape, useArrow=True))
    spark.udf.register("to_gfm", F.udf(lambda h: None if h is None else gfm.to_gfm(h), T.StringType(), useArrow=True))
    for name, f in (("markdown_tables", pages.markdown_tables), ("absolute_links", pages.absolute_links), ("resolve_url", transport.resolve_url)):
        spark.udf.register(name, f)
