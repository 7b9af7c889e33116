"""The page family in SQL: a page parsed token by token by a recursive query, pruned, routed, cut into blocks and extracted.

This is the yardstick of the page operators. It shares no code with them, but was written from them: it finds slips of coding,
not misreadings of the rules. It reads
explicit html, head and body tags, quoted attributes and the references in REFERENCES, which is what the stored pages hold."""

from __future__ import annotations

# The white space and CJK classes in the spelling of the other engine.
W = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
C = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"

PROSE = "The committee met on Tuesday, and it decided to keep the old bridge open for another year. "


def page(body: str, title: str = "A title", head: str = "") -> str:
    return f'<!DOCTYPE html><html lang="en"><head><title>{title}</title>{head}</head><body>{body}</body></html>'


def linked(n: int, text: str = "entry", tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/e{i}">{text} {i}</a></{tag}>' for i in range(n))


def grid(rows: int, columns: int) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>cell {r} {c}</td>" for c in range(columns)) + "</tr>" for r in range(rows)) + "</table>"


def paragraphs(n: int) -> str:
    return "".join(f"<p>{PROSE}Part {i}.</p>" for i in range(n))


#: One page for each rule that the stored pages never reach.
EXTRA_PAGES = [
    page(f'<div><h1>Lamp</h1><span itemprop="price">5</span><span itemprop="brand offers">x</span>{grid(3, 2)}</div>'),
    page(f"<div>{paragraphs(3)}</div>", head='<script type="application/ld+json">{"@type": "Product", "offers": {"@type": ["https://schema.org/Offer", "x:Thing"]}}</script>'),
    page(f'<section itemtype="https://schema.org/OfferCatalog http://x.test/#List">{paragraphs(2)}</section>'),
    page(f'<article class="post first"><p>{PROSE}</p></article><article class="post"><p>{PROSE}</p><p>{PROSE}</p></article>'),
    page(f"<h1>Figures</h1><div>{grid(4, 3)}</div>"),
    page(f"<section><h1>Two</h1>{grid(2, 2)}<div>{grid(3, 4)}</div></section>"),
    page(f"<h1>Index</h1><ul>{linked(3)}<li>none</li><li>none</li></ul><ol>{linked(7)}</ol>"),
    page(f'<section><div>{linked(9, "far", "span")}</div><div>{linked(8, "near", "div")}</div></section>'),
    page(f"<div><ul>{linked(4)}</ul>{paragraphs(1)}</div>"),
    page("<div><p>委員会は火曜日に集まり、古い橋をもう一年開けておくことにした。</p><p>短い文だ。</p><li>これは項目です。</li></div>"),
    page(f'<div id="onetrust-banner">{paragraphs(1)}</div><div class="interstitial">{paragraphs(1)}</div><p class="x" aria-label="Cookie notice">{PROSE}</p><div class="promo_ad">{paragraphs(1)}</div>'
         f'<section class="partnerbox"><a href="/1">a</a><a href="/2">b</a><a href="/3">c</a></section><main><h2>Kept</h2>{paragraphs(4)}</main>'),
    page("".join(f"<h2>Part {i}</h2>{paragraphs(8)}" for i in range(5)) + f"<p>{linked(22, 'see', 'b')}</p>"),
    page(f"<div>{paragraphs(6)}</div><div>{paragraphs(1)}</div>"),
    page(f"<div><h2>One</h2><p>{PROSE}</p></div><section><p>{PROSE * 2}</p><div>{paragraphs(1)}</div></section><div>{paragraphs(1)}<blockquote>{PROSE}</blockquote></div><div><pre>{PROSE}</pre></div>"),
    page("", title=""),
    page(f'<article><h1></h1><table><tr><td>in the article &amp; out &lt;x&gt;</td><td>second cell</td></tr></table><!-- note --><ul><li>one long item of text<li>two, with <a href="/x">a link that is most of it</a></ul><p>{PROSE}</p>unfinished'),
    page(f"<div><p>{PROSE}<div><p>{PROSE}</div></p><span>x</span></div></b><h1>After</h1>"),
]
EXTRA_PAGES = [(-i - 1, f"https://x.test/extra/{i}", html) for i, html in enumerate(EXTRA_PAGES)]


def units(t: str) -> str:
    return rf"(length({t}) + length(regexp_replace({t}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def stripped(t: str) -> str:
    return f"regexp_replace({t}, '^[{W}]+|[{W}]+$', '', 'g')"


def squeezed(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{W}]+', ' ', 'g'))"


def cjk(t: str) -> str:
    n = f"length(regexp_replace({t}, '[^{C}]', '', 'g'))"
    return f"({n} > 0 AND {n} > 0.3::DOUBLE * {units(t)})"


def prose(t: str) -> str:
    return f"({cjk(t)} OR regexp_matches({stripped(t)}, '[.!?;:][\"'')\\]]?[{W}]|[.!?]$'))"


def names(text: str) -> str:
    return "(" + ", ".join(f"'{x}'" for x in text.split()) + ")"


def listed(text: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in text.split()) + "]"


# Classes of elements and tokens, as HTML and the extractor's rules have them.
VOID = names("area base br col embed hr img input link meta param source track wbr")
CLOSE_P = names("address article aside blockquote details div dl fieldset figcaption figure footer form header hr main nav ol pre section table ul h1 h2 h3 h4 h5 h6 p")
CLEANED = names("script style noscript iframe frame object embed applet aside nav footer form dialog button select textarea input canvas svg template")
IDS = listed("cookie consent gdpr cmp ccpa onetrust didomi usercentrics cookiebot trustarc sourcepoint ad ads advert advertisement sponsored promo")
CLASSES = listed("interstitial ad ads advert advertisement sponsored promo")
BLOCKS = names("p h1 h2 h3 h4 h5 h6 li td th blockquote pre")
HEADINGS = names("h1 h2 h3 h4 h5 h6")
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def attribute(name: str) -> str:
    return f"CASE WHEN regexp_matches(t, '\\s{name}=\"') THEN regexp_extract(t, '\\s{name}=\"([^\"]*)\"', 1) END"


def unescaped(t: str) -> str:
    for name, char in REFERENCES:
        t = f"replace({t}, '{name}', '{char}')"
    return t


def rows_of(extra: bool) -> str:
    more = " UNION ALL SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(i, u, h.replace("'", "''")) for i, u, h in EXTRA_PAGES) + ") v(page_id, url, html)" if extra else ""
    return f"src AS (SELECT page_id, url, html FROM pages{more})"


TOKEN = r"(?is)<!--.*?-->|<!doctype[^>]*>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|</?[a-z][^>]*>|[^<]+"


def nodes(extra: bool = True) -> str:
    """CTEs up to nodes(page_id, node_id, last_id, parent_id, depth, kind, tag, t, text)."""
    return rf"""WITH RECURSIVE {rows_of(extra)},
cut AS (SELECT page_id, unnest(flatten(list_transform(regexp_extract_all(html, '{TOKEN}'), lambda x:
    CASE WHEN regexp_matches(x, '(?i)^<(script|style)\b') THEN [regexp_extract(x, '^<[^>]*>'), chr(2) || regexp_extract(x, '(?s)^<[^>]*>(.*)</[a-zA-Z]+>$', 1), regexp_extract(x, '</[a-zA-Z]+>$')] ELSE [x] END))) AS t,
  unnest(range(len(flatten(list_transform(regexp_extract_all(html, '{TOKEN}'), lambda x: CASE WHEN regexp_matches(x, '(?i)^<(script|style)\b') THEN [1, 2, 3] ELSE [1] END))))) AS j FROM src),
kinds AS (SELECT *, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM cut),
tok AS (SELECT page_id, t, name, CASE WHEN starts_with(t, '<!--') THEN 'comment' WHEN starts_with(t, '</') THEN 'end' WHEN name IN {VOID} THEN 'void' WHEN name <> '' THEN 'start' ELSE 'text' END AS what,
  row_number() OVER (PARTITION BY page_id ORDER BY j) AS i FROM kinds WHERE t <> '' AND t <> chr(2) AND NOT starts_with(lower(t), '<!doctype') AND NOT (name = 'html')),
tok_lists AS MATERIALIZED (SELECT page_id, list({{'what': what, 'name': name, 't': t}} ORDER BY i) AS toks FROM tok GROUP BY page_id),
walk AS (
  SELECT page_id, 0::BIGINT AS i, 1 AS n, ['html'] AS tags, [0] AS ids, 0 AS node_id, -1 AS parent_id, 0 AS depth, 'element' AS kind, 'html' AS tag, '' AS t FROM src
  UNION ALL
  SELECT page_id, i, CASE WHEN what = 'end' THEN n ELSE n + 1 END,
    CASE WHEN what = 'start' THEN list_append(open_tags, name) ELSE open_tags END, CASE WHEN what = 'start' THEN list_append(open_ids, n) ELSE open_ids END,
    CASE WHEN what <> 'end' THEN n END, open_ids[len(open_ids)], len(open_ids), CASE WHEN what IN ('text', 'comment') THEN what ELSE 'element' END, CASE WHEN what IN ('text', 'comment') THEN '' ELSE name END, t
  FROM (SELECT *, tags[1:keep] AS open_tags, ids[1:keep] AS open_ids FROM (SELECT *,
      CASE WHEN what IN ('start', 'void') AND name IN ('head', 'body') THEN 1
        WHEN what IN ('start', 'void') THEN len(tags) - least(len(tags) - 2, coalesce(list_position(list_transform(list_reverse(tags), lambda x: list_contains(closes, x)), false), len(tags) + 1) - 1)
        WHEN what = 'end' AND name = 'head' THEN 1
        WHEN what = 'end' AND list_position(list_reverse(tags), name) IS NOT NULL AND len(tags) - list_position(list_reverse(tags), name) >= 2 THEN len(tags) - list_position(list_reverse(tags), name)
        ELSE len(tags) END AS keep
    FROM (SELECT page_id, i, n, tags, ids, k.what, k.name, k.t,
        CASE WHEN k.name IN {CLOSE_P} THEN ['p'] WHEN k.name = 'li' THEN ['li'] WHEN k.name = 'tr' THEN ['tr', 'td', 'th'] WHEN k.name = 'td' THEN ['td', 'th', 'thead'] WHEN k.name = 'th' THEN ['th', 'td'] ELSE []::VARCHAR[] END AS closes
      FROM (SELECT w.page_id, w.i + 1 AS i, w.n, w.tags, w.ids, l.toks[w.i + 1] AS k FROM walk w JOIN tok_lists l ON l.page_id = w.page_id WHERE w.i < len(l.toks)))))),
found AS MATERIALIZED (SELECT page_id, node_id, parent_id, depth, kind, tag, t,
  CASE WHEN kind = 'comment' THEN substring(t, 5, length(t) - 7) WHEN kind = 'element' THEN '' WHEN starts_with(t, chr(2)) THEN substring(t, 2) ELSE {unescaped('t')} END AS text FROM walk WHERE node_id IS NOT NULL),
ends AS (SELECT a.page_id, a.node_id, min(b.node_id) - 1 AS last_id FROM found a JOIN found b ON a.page_id = b.page_id AND b.node_id > a.node_id AND b.depth <= a.depth GROUP BY ALL),
nodes AS MATERIALIZED (SELECT f.*, CAST(coalesce(e.last_id, max(f.node_id) OVER (PARTITION BY f.page_id)) AS INTEGER) AS last_id,
  {attribute('id')} AS id_attr, {attribute('class')} AS class_attr, {attribute('aria-label')} AS aria_label FROM found f LEFT JOIN ends e USING (page_id, node_id))"""


def less(name: str, rows: str, roots: str) -> str:
    """A CTE of the rows outside the subtrees of the roots."""
    return f"{name} AS MATERIALIZED (SELECT n.* FROM {rows} n WHERE NOT EXISTS (SELECT 1 FROM {roots} r WHERE r.page_id = n.page_id AND n.node_id BETWEEN r.node_id AND r.last_id))"


def tokens(column: str) -> str:
    return f"string_split_regex(regexp_replace(lower(coalesce({column}, '')), '[{W}]+', '_', 'g'), '[_-]+')"


def pruned(extra: bool = True) -> str:
    """CTEs up to p, the nodes that pruning leaves, numbered anew, and content, the text of each element."""
    return nodes(extra) + rf""",
never AS (SELECT * FROM nodes WHERE tag IN {CLEANED}), {less('left1', 'nodes', 'never')},
noise AS (SELECT * FROM left1 WHERE kind = 'element' AND (id_attr IS NOT NULL OR class_attr IS NOT NULL)
  AND (list_has_any({tokens('id_attr')}, {IDS}) OR list_has_any({tokens('class_attr')}, {CLASSES}) OR regexp_matches(lower(coalesce(aria_label, '')), 'cookie|consent|gdpr'))), {less('left2', 'left1', 'noise')},
farms AS (SELECT b.page_id, b.node_id, b.last_id FROM left2 b JOIN left2 d ON d.page_id = b.page_id AND d.node_id > b.node_id AND d.node_id <= b.last_id
  WHERE b.tag IN ('div', 'section', 'li') AND regexp_matches(coalesce(b.class_attr, '') || coalesce(b.id_attr, ''), '(?i)ad|sponsor|promo|partner') GROUP BY ALL
  HAVING count(*) FILTER (d.tag = 'a') >= 3 AND {units(stripped("coalesce(string_agg(d.text, '' ORDER BY d.node_id) FILTER (d.kind = 'text'), '')"))} BETWEEN 1 AND 39), {less('left3', 'left2', 'farms')},
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY node_id) - 1 AS INTEGER) AS k FROM left3),
p AS MATERIALIZED (SELECT n.page_id, n.k AS node_id, max(d.k) AS last_id, CAST(coalesce(any_value(u.k), -1) AS INTEGER) AS parent_id, n.depth, n.kind, n.tag, n.t, n.text, n.id_attr, n.class_attr, n.aria_label
  FROM numbered n LEFT JOIN numbered d ON d.page_id = n.page_id AND d.node_id BETWEEN n.node_id AND n.last_id LEFT JOIN numbered u ON u.page_id = n.page_id AND u.node_id = n.parent_id GROUP BY ALL),
content AS MATERIALIZED (SELECT e.page_id, e.node_id, e.last_id, e.parent_id, e.depth, e.tag, coalesce(string_agg(x.text, '' ORDER BY x.node_id), '') AS said
  FROM p e LEFT JOIN p x ON x.page_id = e.page_id AND x.kind = 'text' AND x.node_id BETWEEN e.node_id AND e.last_id WHERE e.kind = 'element' GROUP BY ALL)"""


SIGNALS = r"""sig AS (SELECT page_id,
  list_transform(coalesce(flatten(list(CASE WHEN tag = 'script' AND contains(t, 'application/ld+json') THEN regexp_extract_all(said, '"@type": *\[?"([^"\]]+)"', 1) || regexp_extract_all(said, '"@type": *\[[^\]]*, *"([^"]+)"', 1) END ORDER BY node_id) FILTER (kind = 'element')), []), lambda x: {name}) AS jsonld,
  list_transform(list_filter(string_split(coalesce(string_agg(nullif(regexp_extract(t, '\sitemprop="([^"]*)"', 1), ''), ' ' ORDER BY node_id), ''), ' '), lambda x: x <> ''), lambda x: lower(x)) AS itemprop,
  list_transform(list_filter(string_split(coalesce(string_agg(nullif(regexp_extract(t, '\sitemtype="([^"]*)"', 1), ''), ' ' ORDER BY node_id), ''), ' '), lambda x: x <> ''), lambda x: {name}) AS itemtype,
  CAST(count(*) FILTER (tag = 'article' AND list_contains(string_split(coalesce(class_attr, ''), ' '), 'post')) AS INTEGER) AS posts
 FROM (SELECT n.*, (SELECT any_value(x.text) FROM nodes x WHERE x.page_id = n.page_id AND x.parent_id = n.node_id AND n.tag = 'script') AS said FROM nodes n) GROUP BY page_id)""".replace(
    "{name}", "lower(CASE WHEN regexp_matches(x, '[/#]') THEN regexp_extract(x, '([^/#]*)$', 1) ELSE regexp_replace(x, '^[^:]*:', '') END)")


def below(tag: str) -> str:
    return f"CAST(count(*) FILTER (tag IN {names(tag)}) AS INTEGER)"


ROUTES = f"""counted AS (SELECT page_id, {below('li')} AS li, {below('a')} AS a, {below('table')} AS "table",
  CAST(count(*) FILTER (tag = 'table' AND EXISTS (SELECT 1 FROM p r WHERE r.page_id = p.page_id AND r.tag = 'article' AND p.node_id BETWEEN r.node_id AND r.last_id)) AS INTEGER) AS table_in_article,
  {below('article')} AS article, {below('main')} AS main, {below('h1 h2 h3')} AS headings FROM p GROUP BY page_id),
sized AS (SELECT page_id, CAST({units(stripped(squeezed('said')))} AS INTEGER) AS text_chars FROM content WHERE tag = 'body'),
facts AS (SELECT *, CASE WHEN text_chars > 0 THEN a / text_chars * 100 ELSE 0.0::DOUBLE END AS link_density, table_in_article = 0 AS free,
  list_contains(jsonld || itemtype, 'product') OR list_has_any(itemprop, ['product', 'offer']) OR len(list_intersect(itemprop, ['price', 'offers', 'sku', 'gtin', 'mpn', 'brand'])) >= 2 AS product
  FROM counted JOIN sized USING (page_id) JOIN sig USING (page_id)),
rule AS (SELECT *, CASE WHEN product AND free AND "table" >= 1 THEN 'product table' WHEN product THEN 'product article'
  WHEN list_contains(jsonld || itemtype, 'offercatalog') THEN 'collection article'
  WHEN posts >= 2 OR list_contains(jsonld, 'discussionforumposting') OR list_contains(jsonld || itemtype, 'forum') THEN 'forum article'
  WHEN free AND "table" = 1 AND li < 10 AND a < 20 AND headings <= 2 THEN 'collection table' WHEN free AND "table" >= 2 AND li < 15 THEN 'collection table'
  WHEN li >= 6 AND a >= 6 AND text_chars < 2000 THEN 'listing list' WHEN a >= 15 AND link_density >= 2 AND "table" = 0 AND article = 0 THEN 'listing list'
  WHEN li >= 4 AND a >= 4 AND text_chars < 2000 THEN 'collection article' WHEN text_chars > 3000 AND headings >= 5 AND a >= 20 THEN 'collection article' ELSE 'article article' END AS r FROM facts),
routed AS (SELECT *, split_part(r, ' ', 1) AS page_type, split_part(r, ' ', 2) AS strategy FROM rule)"""

PIECES = f"""spoken AS (SELECT *, {squeezed('said')} AS words FROM content WHERE tag IN {BLOCKS}),
linked AS (SELECT s.page_id, s.node_id, coalesce(string_agg(a.said, ' ' ORDER BY a.node_id), '') AS links
  FROM spoken s LEFT JOIN content a ON a.page_id = s.page_id AND a.tag = 'a' AND a.node_id > s.node_id AND a.node_id <= s.last_id GROUP BY ALL),
b AS MATERIALIZED (SELECT page_id, node_id, parent_id, words, CAST({units('words')} AS INTEGER) AS length, {units(squeezed('links'))} / {units('words')} AS link_density
  FROM spoken JOIN linked USING (page_id, node_id)
  WHERE words <> '' AND {units('words')} >= CASE WHEN {cjk('words')} THEN 8 WHEN tag IN ('td', 'th', 'li') THEN 5 ELSE 25 END
   AND {units(squeezed('links'))} / {units('words')} <= 0.2::DOUBLE AND (tag IN ('td', 'th', 'li') OR {prose('words')}))"""

BOXES = f"""held AS (SELECT e.page_id, e.node_id, e.tag, e.depth, e.last_id, sum(b.length) AS chars, count(*) AS block_count, min(b.node_id) AS first_block
  FROM p e JOIN b ON b.page_id = e.page_id AND b.node_id > e.node_id AND b.node_id <= e.last_id WHERE e.kind = 'element' AND e.tag NOT IN ('html', 'body') GROUP BY ALL),
boxes AS MATERIALIZED (SELECT h.*, CAST(chars + CASE WHEN tag IN ('article', 'main') THEN 200 ELSE 0 END
  + 60 * (SELECT count(*) FROM p x WHERE x.page_id = h.page_id AND x.tag IN {HEADINGS} AND x.node_id > h.node_id AND x.node_id <= h.last_id) AS BIGINT) AS score FROM held h),
steps AS (SELECT *, CASE WHEN lag(parent_id) OVER w = parent_id THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY page_id ORDER BY node_id)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY node_id) AS run FROM steps),
runs AS (SELECT page_id, run, any_value(parent_id) AS parent_id, count(*) AS blocks FROM grouped GROUP BY page_id, run),
longest AS (SELECT page_id, parent_id, blocks FROM runs QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY blocks DESC, run) = 1)"""

MAINS = f"""total AS (SELECT page_id, count(b.node_id) AS n_blocks FROM src LEFT JOIN b USING (page_id) GROUP BY page_id),
firsts AS (SELECT page_id, tag, min_by(node_id, node_id) AS node_id, min_by(last_id, node_id) AS last_id FROM p WHERE tag IN ('article', 'main') GROUP BY ALL),
half AS (SELECT f.page_id, f.tag, f.node_id FROM firsts f JOIN b ON b.page_id = f.page_id AND b.node_id BETWEEN f.node_id AND f.last_id JOIN total t ON t.page_id = f.page_id GROUP BY f.page_id, f.tag, f.node_id, t.n_blocks HAVING 2 * count(*) >= t.n_blocks),
named AS (SELECT page_id, min_by(node_id, tag) AS main FROM half GROUP BY page_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, first_block, depth DESC) AS place, lead(score) OVER (PARTITION BY page_id ORDER BY score DESC, first_block, depth DESC) AS second FROM boxes),
by_score AS (SELECT r.page_id, CASE WHEN 2 * block_count >= n_blocks OR coalesce(second, 0) = 0 OR score >= 1.4::DOUBLE * second THEN r.node_id ELSE l.parent_id END AS main
  FROM ranked r JOIN total USING (page_id) JOIN longest l USING (page_id) WHERE place = 1),
kids AS (SELECT c.page_id, c.parent_id, c.tag, EXISTS (SELECT 1 FROM p a WHERE a.page_id = c.page_id AND a.tag = 'a' AND a.node_id > c.node_id AND a.node_id <= c.last_id) AS has_link FROM p c WHERE c.kind = 'element'),
sums AS (SELECT e.page_id, e.node_id, e.tag, e.depth, count(*) FILTER (k.has_link) AS linked, count(*) FILTER (k.tag = 'li') AS items, count(*) FILTER (k.tag = 'li' AND k.has_link) AS linked_items
  FROM p e JOIN kids k ON k.page_id = e.page_id AND k.parent_id = e.node_id WHERE e.tag IN ('ul', 'ol', 'div', 'section') GROUP BY ALL),
lists AS (SELECT page_id, node_id AS main FROM sums WHERE tag IN ('ul', 'ol') AND linked_items >= 3 AND linked_items >= 0.6::DOUBLE * items QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY linked_items DESC, node_id) = 1),
divs AS (SELECT page_id, node_id AS main FROM sums WHERE tag IN ('div', 'section') AND linked >= 3 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY linked DESC, depth DESC, node_id) = 1),
tables AS (SELECT e.page_id, e.node_id, e.last_id, count(*) FILTER (d.tag IN ('td', 'th')) AS cells FROM p e JOIN p d ON d.page_id = e.page_id AND d.node_id > e.node_id AND d.node_id <= e.last_id
  WHERE e.tag = 'table' GROUP BY ALL HAVING count(*) FILTER (d.tag = 'tr') >= 2 AND count(*) FILTER (d.tag IN ('td', 'th')) >= 4),
largest AS (SELECT * FROM tables QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY cells DESC, node_id) = 1),
heads AS (SELECT page_id, min(node_id) AS head FROM p WHERE tag = 'h1' GROUP BY page_id HAVING count(*) = 1),
shared AS (SELECT l.page_id, max(a.node_id) AS up FROM largest l JOIN heads h USING (page_id) JOIN p a ON a.page_id = l.page_id AND a.kind = 'element' AND h.head BETWEEN a.node_id AND a.last_id AND l.node_id > a.node_id AND l.node_id <= a.last_id
  WHERE NOT h.head BETWEEN l.node_id AND l.last_id GROUP BY l.page_id),
with_head AS (SELECT l.page_id, CASE WHEN s.up IS NULL OR s.up = 0 OR EXISTS (SELECT 1 FROM p y WHERE y.page_id = l.page_id AND y.tag = 'body' AND y.node_id = s.up) THEN l.node_id ELSE s.up END AS main FROM largest l LEFT JOIN shared s USING (page_id)),
chosen AS (SELECT r.page_id, r.page_type, r.strategy, CASE strategy WHEN 'list' THEN coalesce(ls.main, dv.main) WHEN 'table' THEN th.main ELSE coalesce(nm.main, bs.main) END AS main
  FROM routed r LEFT JOIN lists ls USING (page_id) LEFT JOIN divs dv USING (page_id) LEFT JOIN with_head th USING (page_id) LEFT JOIN named nm USING (page_id) LEFT JOIN by_score bs USING (page_id)),
mains AS (SELECT c.*, m.last_id, m.tag, m.said, t.n_blocks, (SELECT count(*) FROM b WHERE b.page_id = c.page_id AND b.node_id BETWEEN c.main AND m.last_id) AS n_main_blocks
  FROM chosen c JOIN total t USING (page_id) LEFT JOIN content m ON m.page_id = c.page_id AND m.node_id = c.main),
c1 AS (SELECT *, CASE WHEN n_blocks > 0 AND main IS NOT NULL THEN n_main_blocks / n_blocks ELSE 0.0::DOUBLE END AS conf1 FROM mains),
c2 AS (SELECT *, CASE WHEN tag IN ('article', 'main') THEN least(1.0::DOUBLE, conf1 + 0.15::DOUBLE) ELSE conf1 END AS conf2 FROM c1),
c3 AS (SELECT *, CASE WHEN main IS NULL OR {units('said')} < 80 THEN least(conf2, 0.4::DOUBLE) ELSE conf2 END AS conf3 FROM c2),
h1s AS (SELECT m.page_id, min_by(x.said, x.node_id) AS said FROM mains m JOIN content x ON x.page_id = m.page_id AND x.tag = 'h1' AND x.node_id > m.main AND x.node_id <= m.last_id GROUP BY m.page_id),
titles AS (SELECT page_id, min_by(said, node_id) AS said FROM content WHERE tag = 'title' GROUP BY page_id),
events AS (SELECT m.page_id, x.node_id AS place, 0 AS close, 0 AS deep, CASE x.kind WHEN 'text' THEN replace(replace(replace(x.text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') WHEN 'comment' THEN '<!--' || x.text || '-->'
   ELSE '<' || x.tag || regexp_extract(x.t, '^<[a-zA-Z0-9]+([^>]*)>$', 1) || '>' END AS s FROM mains m JOIN p x ON x.page_id = m.page_id AND x.node_id BETWEEN m.main AND m.last_id
  UNION ALL SELECT m.page_id, x.last_id, 1, -x.depth, '</' || x.tag || '>' FROM mains m JOIN p x ON x.page_id = m.page_id AND x.node_id BETWEEN m.main AND m.last_id WHERE x.kind = 'element' AND x.tag NOT IN {VOID}),
shown AS (SELECT page_id, string_agg(s, '' ORDER BY place, close, deep) AS main_html FROM events GROUP BY page_id),
extracted AS (SELECT page_id, coalesce(nullif({stripped('h1s.said')}, ''), {stripped('titles.said')}) AS title, coalesce(main_html, '') AS main_html,
  floor(CASE WHEN page_type <> 'article' THEN least(conf3, 0.75::DOUBLE) ELSE conf3 END * 100 + 0.5::DOUBLE) / 100 AS confidence, main IS NULL AS escalate, page_type, strategy, CAST(n_blocks AS INTEGER) AS n_blocks, CAST(CASE WHEN main IS NULL THEN 0 ELSE n_main_blocks END AS INTEGER) AS n_main_blocks
  FROM c3 LEFT JOIN h1s USING (page_id) LEFT JOIN titles USING (page_id) LEFT JOIN shown USING (page_id))"""

NODE = "page_id, CAST(node_id AS INTEGER) AS node_id, last_id, CAST(parent_id AS INTEGER) AS parent_id, CAST(depth AS INTEGER) AS depth, kind, tag, id_attr, class_attr, aria_label, text"
COUNTS = 'li, a, "table", table_in_article, article, main, headings, text_chars, link_density'
DOM_NODES = nodes() + f" SELECT {NODE} FROM nodes"
PRUNED_NODES = pruned() + f" SELECT {NODE} FROM p"
PAGE_SIGNALS = nodes() + f", {SIGNALS} SELECT * FROM sig"
PAGE_ROUTE = pruned() + f", {SIGNALS}, {ROUTES} SELECT page_id, page_type, strategy, {COUNTS} FROM routed"
TEXT_BLOCKS = pruned() + f", {PIECES} SELECT page_id, node_id AS node, words AS text, length, link_density FROM b"
CONTAINER_SCORES = pruned() + f", {PIECES}, {BOXES} SELECT page_id, node_id, tag, score, block_count FROM boxes"
BLOCK_RUNS = pruned() + f", {PIECES}, {BOXES} SELECT page_id, parent_id, blocks FROM longest"
EXTRACT = f", {SIGNALS}, {ROUTES}, {PIECES}, {BOXES}, {MAINS}"
EXTRACT_PAGES = pruned() + EXTRACT + " SELECT * FROM extracted"


def replaced(sql: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        if sql.count(old) != 1:
            raise ValueError(old)
        sql = sql.replace(old, new)
    return sql


CONFIDENCE, FLOORS = "CASE WHEN page_type <> 'article' THEN least(conf3, 0.75::DOUBLE) ELSE conf3 END", "THEN 5 ELSE 25 END"
EXTRACT_PRECISE = replaced(EXTRACT_PAGES, (FLOORS, "THEN 12 ELSE 60 END"), (CONFIDENCE, f"least({CONFIDENCE}, 0.85::DOUBLE)"))
EXTRACT_RECALL = replaced(EXTRACT_PAGES, (FLOORS, "THEN 5 ELSE 15 END"), (CONFIDENCE, f"greatest({CONFIDENCE}, 0.3::DOUBLE)"))
#: Less all sections, and paragraphs that are children of a main or div.
EXTRACT_PRUNED = replaced(EXTRACT_PAGES, ("numbered AS (", "wanted_out AS (SELECT n.* FROM left3 n WHERE tag = 'section' OR tag = 'p' AND EXISTS (SELECT 1 FROM left3 u WHERE u.page_id = n.page_id AND u.node_id = n.parent_id AND u.tag IN ('main', 'div'))), " + less("left4", "left3", "wanted_out") + ",\nnumbered AS ("), ("FROM left3),\np AS", "FROM left4),\np AS"))
