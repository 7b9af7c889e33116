"""A page as rows in document order.

Row i's subtree is rows i to last[i], so ancestry is a comparison of numbers, in a worker as in a join. The
parser is forgiving in the way of streaming parsers: a start tag closes the open element on top of the stack if
it implies that, an end tag closes down to its element or is ignored, and what is open at the end closes there."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from html.parser import HTMLParser

from .js import SPACE

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset({"script", "style"})
BLOCKS = "address article aside blockquote details div dl fieldset figcaption figure footer form header hr main nav ol pre section table ul h1 h2 h3 h4 h5 h6 p"
IMPLIES = {tag: frozenset({"p"}) for tag in BLOCKS.split()} | {
    "li": frozenset({"li"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th", "thead"}), "th": frozenset({"th", "td"}), "tbody": frozenset({"thead", "tbody"}),
    "tfoot": frozenset({"thead", "tbody"}), "option": frozenset({"option"}), "optgroup": frozenset({"optgroup", "option"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}),
}
IN_HEAD = frozenset("title meta link script style base noscript template".split())


@dataclass
class Page:
    kind: list[str] = field(default_factory=list)  # element, text, comment
    tag: list[str] = field(default_factory=list)
    attrs: list[dict[str, str]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)  # number of ancestors
    # Made when the page is closed: the rows of each tag, the text rows, and the elements below each row.
    rows_of: dict[str, list[int]] = field(default_factory=dict, repr=False)
    texts: list[int] = field(default_factory=list, repr=False)
    kids: dict[int, list[int]] = field(default_factory=dict, repr=False)

    def add(self, kind: str, tag: str, attrs: dict[str, str], text: str, parent: int) -> int:
        i = len(self.kind)
        self.kind.append(kind)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.parent.append(parent)
        self.last.append(i)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        return i

    def close(self) -> Page:
        """Fills in what follows from the parents, in one pass each way."""
        last, parent = self.last, self.parent
        for i in range(len(last) - 1, 0, -1):
            if last[parent[i]] < last[i]:
                last[parent[i]] = last[i]
        for i, kind in enumerate(self.kind):
            if kind == "text":
                self.texts.append(i)
            elif kind == "element":
                self.rows_of.setdefault(self.tag[i], []).append(i)
                self.kids.setdefault(parent[i], []).append(i)
        return self

    def find(self, *tags: str, under: int | None = None) -> list[int]:
        """Elements with one of the tags, in document order; strictly below `under` if it is given."""
        found: list[int] = []
        for tag in tags:
            rows = self.rows_of.get(tag)
            if rows:
                found += rows if under is None else rows[bisect_right(rows, under) : bisect_right(rows, self.last[under])]
        return sorted(found) if len(tags) > 1 else found

    def count(self, *tags: str, under: int) -> int:
        """How many elements with one of the tags stand strictly below `under`."""
        lists = [rows for t in tags if (rows := self.rows_of.get(t))]
        return sum(bisect_right(rows, self.last[under]) - bisect_right(rows, under) for rows in lists)

    def elements(self) -> list[int]:
        return [i for i, k in enumerate(self.kind) if k == "element"]

    def children(self, i: int) -> list[int]:
        return self.kids.get(i, [])

    def ancestors(self, i: int) -> list[int]:
        out = []
        while (i := self.parent[i]) >= 0:
            out.append(i)
        return out

    def contains(self, a: int, b: int) -> bool:
        return a <= b <= self.last[a]

    def content(self, i: int) -> str:
        at = self.texts
        return "".join([self.text[j] for j in at[bisect_left(at, i) : bisect_right(at, self.last[i])]])

    def body(self) -> int | None:
        return next(iter(self.find("body")), None)

    def without(self, roots: list[int]) -> Page:
        """The page less the subtrees of these rows, numbered anew."""
        if not roots:
            return self
        gone = bytearray(len(self.kind))
        for r in roots:
            gone[r : self.last[r] + 1] = b"\1" * (self.last[r] + 1 - r)
        out, to = Page(), {-1: -1}
        for i, g in enumerate(gone):
            if not g:
                to[i] = out.add(self.kind[i], self.tag[i], self.attrs[i], self.text[i], to[self.parent[i]])
        return out.close()

    def serialise(self, root: int) -> str:
        out, open_ = [], []
        for i in range(root, self.last[root] + 1):
            while open_ and i > self.last[open_[-1]]:
                out.append(f"</{self.tag[open_.pop()]}>")
            if self.kind[i] == "text":
                out.append(self.text[i] if self.tag[self.parent[i]] in RAW else html.escape(self.text[i], quote=False))
            elif self.kind[i] == "comment":
                out.append(f"<!--{self.text[i]}-->")
            else:
                attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs[i].items())
                out.append(f"<{self.tag[i]}{attrs}>")
                if self.tag[i] not in VOID:
                    open_.append(i)
        return "".join(out) + "".join(f"</{self.tag[i]}>" for i in reversed(open_))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.root = self.page.add("element", "html", {}, "", -1)
        self.head = self.body = None
        self.stack = [self.root]

    def place(self, tag: str | None = None) -> None:
        """Opens the head or the body if what comes next needs it."""
        if len(self.stack) > 1:
            if self.stack[-1] == self.head and tag not in IN_HEAD and tag is not None:
                self.stack = [self.root]
            else:
                return
        if tag in IN_HEAD and self.body is None:
            if self.head is None:
                self.head = self.page.add("element", "head", {}, "", self.root)
            self.stack = [self.root, self.head]
        else:
            if self.body is None:
                self.body = self.page.add("element", "body", {}, "", self.root)
            self.stack = [self.root, self.body]

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.page.attrs[self.root].update(attrs)
            return
        if tag in ("head", "body"):
            at = getattr(self, tag)
            if at is None:
                at = self.page.add("element", tag, attrs, "", self.root)
                setattr(self, tag, at)
            self.stack = [self.root, at]
            return
        self.place(tag)
        while len(self.stack) > 2 and self.page.tag[self.stack[-1]] in IMPLIES.get(tag, ()):
            self.stack.pop()
        i = self.page.add("element", tag, attrs, "", self.stack[-1])
        if tag not in VOID:
            self.stack.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.page.tag[self.stack[-1]] == tag and len(self.stack) > 2:
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag == "head" and self.stack[1:2] == [self.head]:
            self.stack = [self.root]
        if tag in VOID or tag in ("html", "head", "body"):
            return
        for k in range(len(self.stack) - 1, 1, -1):
            if self.page.tag[self.stack[k]] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if len(self.stack) == 1 or self.stack[-1] == self.head:
            if not SPACE.sub("", data):
                return
            self.stack = [self.root]
            self.place("#text")
        self.page.add("text", "", {}, data, self.stack[-1])

    def handle_comment(self, data):
        self.page.add("comment", "", {}, data, self.stack[-1])

    def parse_marked_section(self, i, report=1):
        """A marked section (as `<![x[`) is a comment up to the next `>`, whatever is in it."""
        return self.parse_bogus_comment(i)


#: Zeros in front, and numbers of so many digits that they name no character: too long ones cannot be read as numbers.
_ZEROS, _BEYOND = re.compile("&#0{9,}(?=[0-9])"), re.compile("&#[0-9]{9,}")


def parse(source: str | None) -> Page:
    """The page of any string: empty input gives html, head and body."""
    b = _Builder()
    b.feed(_BEYOND.sub("&#99999999", _ZEROS.sub("&#", source or "")))
    b.close()
    for name in ("head", "body"):
        if getattr(b, name) is None:
            setattr(b, name, b.page.add("element", name, {}, "", b.root))
    return ordered(b.page)


def ordered(page: Page) -> Page:
    """Rows in document order: a parent's rows must follow it without a gap, the head before the body."""
    if _in_order(page):
        return page.close()
    kids: dict[int, list[int]] = {}
    for i, p in enumerate(page.parent):
        kids.setdefault(p, []).append(i)
    kids[0] = sorted(kids.get(0, []), key=lambda i: {"head": 0, "body": 2}.get(page.tag[i], 1))
    out, todo = Page(), [(0, -1)]
    while todo:
        i, p = todo.pop()
        at = out.add(page.kind[i], page.tag[i], page.attrs[i], page.text[i], p)
        todo += [(k, at) for k in reversed(kids.get(i, []))]
    return out.close()


def _in_order(page: Page) -> bool:
    """Whether each row stands below the row before it or below one of that row's ancestors, and the head before the body."""
    above, tops = 0, [t for t, p in zip(page.tag, page.parent, strict=True) if p == 0]
    for i, p in enumerate(page.parent[1:], 1):
        while above != p and above >= 0:
            above = page.parent[above]
        if above < 0:
            return False
        above = i
    rank = [{"head": 0, "body": 2}.get(t, 1) for t in tops]
    return rank == sorted(rank)


# A compound selector, what it tests besides the tag, and what stands between compounds.
_TEST = r"[.#][\w-]+|\[[^\]]+\]|:(?:scope|empty|first-child|last-child|only-child|nth-child\(\s*\d+\s*\)|not\([^()]*\))"
_PART = re.compile(rf"(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<rest>(?:{_TEST})*)")
_STEP = re.compile(r"\s*([>+~])\s*|\s+")
_ATTR = re.compile(r"""\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*("[^"]*"|'[^']*'|[^\s\]]+)\s*)?\]\Z""")


def select(page: Page, selector: str) -> list[int]:
    """Elements that match a selector list; none if it can't be read.

    Compounds of tag, class, id, attribute, :scope (the page's root), :empty, :first-child, :last-child, :only-child,
    :nth-child(n) and :not(compound), joined by descendant, child, next-sibling and later-sibling steps."""
    found: set[int] = set()
    for one in re.split(r",(?![^\[(]*[\])])", selector):
        parts = _steps(one.strip())
        if parts is None:
            return []
        found.update(i for i in page.elements() if _fits(page, i, parts, len(parts) - 1))
    return sorted(found)


def _steps(one: str) -> list[tuple[str, str, str]] | None:
    """(step before, tag, tests) of each compound."""
    out, at, step = [], 0, ""
    while at < len(one):
        m = _PART.match(one, at)
        if not m[0]:
            return None
        out.append((step, (m["tag"] or "*").lower(), m["rest"]))
        at = m.end()
        if at < len(one):
            m = _STEP.match(one, at)
            if not m or m.end() == len(one):
                return None
            step, at = m[1] or " ", m.end()
    return out or None


def _fits(page: Page, i: int, parts: list[tuple[str, str, str]], k: int) -> bool:
    step, tag, rest = parts[k]
    if tag not in ("*", page.tag[i]) or not all(_holds(page, i, t) for t in re.findall(_TEST, rest)):
        return False
    if not step:
        return True
    if step in " >":
        near = page.ancestors(i)[: None if step == " " else 1]
    else:
        own = _siblings(page, i)
        near = own[: own.index(i)][::-1][: None if step == "~" else 1]
    return any(_fits(page, j, parts, k - 1) for j in near)


def _siblings(page: Page, i: int) -> list[int]:
    return page.children(page.parent[i]) if page.parent[i] >= 0 else [i]


def _holds(page: Page, i: int, test: str) -> bool:
    attrs = page.attrs[i]
    if test[0] == ".":
        return test[1:] in attrs.get("class", "").split()
    if test[0] == "#":
        return attrs.get("id") == test[1:]
    if test[0] == "[":
        m = _ATTR.match(test)
        if not m or m[1].lower() not in attrs:
            return False
        have, want = attrs[m[1].lower()], (m[3] or "").strip("\"'")
        return {
            None: True, "=": have == want, "~=": want in have.split(), "|=": have == want or have.startswith(want + "-"), "^=": bool(want) and have.startswith(want),
            "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have,
        }[m[2]]
    if test.startswith(":not("):
        inner = _steps(test[5:-1].strip())
        return inner is not None and len(inner) == 1 and not _fits(page, i, inner, 0)
    if test == ":scope":
        return page.parent[i] < 0
    if test == ":empty":
        return page.last[i] == i or all(page.kind[j] == "comment" for j in range(i + 1, page.last[i] + 1))
    own = _siblings(page, i)
    n = own.index(i) + 1
    if test.startswith(":nth-child"):
        return n == int(re.search(r"\d+", test)[0][:9])
    return {":first-child": n == 1, ":last-child": n == len(own), ":only-child": len(own) == 1}[test]
