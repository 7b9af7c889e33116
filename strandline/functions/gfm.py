"""Tables: HTML to a logical grid and to GFM text, GFM text to a grid, and the structural verdict on one."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .js import SPACE, strip

#: No table may grow to more cells than this, whatever its spans say. Numbers of more digits than DIGITS count as this large.
MOST_CELLS, DIGITS = 1_000_000, 9
# Named references in the order in which they are replaced.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"), ("&nbsp;", " "))
_ROW = re.compile(r"<tr[^>]*>[\s\S]*?</tr>", re.I)
_CELL = re.compile(r"<t[dh]([^>]*)>([\s\S]*?)</t[dh]>", re.I)
_CAPTION = re.compile(r"<caption[^>]*>([\s\S]*?)</caption>", re.I)
TABLE = re.compile(r"<table\b[\s\S]*?</table>", re.I)


class TooLarge(ValueError):
    """A table whose spans ask for more than MOST_CELLS cells."""


def _number(digits: str, base: int = 10) -> int:
    digits = digits.lstrip("0")
    return int(digits or "0", base) if len(digits) <= DIGITS else 10**DIGITS


def _char(n: int, raw: str) -> str:
    """The character of a reference; half of a surrogate pair is no character."""
    return raw if n >= 0x110000 else "\ufffd" if 0xD800 <= n < 0xE000 else chr(n)


def decode(text: str) -> str:
    for name, char in ENTITIES:
        text = text.replace(name, char)
    text = re.sub(r"&#([0-9]+);", lambda m: _char(_number(m[1]), m[0]), text)
    return re.sub(r"&#x([0-9a-f]+);", lambda m: _char(_number(m[1], 16), m[0]), text, flags=re.I)


def cell_text(source: str) -> str:
    """References first, so that escaped tags go as tags; line breaks become pipes, and pipes are escaped."""
    text = re.sub(r"<br\s*/?>", " | ", decode(source), flags=re.I)
    text = re.sub(r"<(?!/?br\b)[^>]*>", "", text, flags=re.I)
    return strip(SPACE.sub(" ", text)).replace("|", r"\|")


def _span(attrs: str, name: str) -> int:
    m = re.search(name + r"\s*=\s*[\"']?([0-9]+)", attrs.lower())
    return _number(m[1]) if m else 1


def grid_of(source: str) -> list[list[str]]:
    """The logical grid: a spanning cell's text at its corner, empty cells elsewhere. A span over rows owes an empty
    cell to each of its columns in the rows below, paid when the row reaches that column."""
    grid: list[list[str]] = []
    owed: dict[int, list[int]] = {}  # column -> rows still owed by each span, first come first paid
    for row in _ROW.findall(source):
        cells: list[str] = []

        def pay(cells=cells) -> None:
            while rest := owed.get(len(cells)):
                rest[0] -= 1
                if not rest[0]:
                    rest.pop(0)
                cells.append("")

        for attrs, inner in _CELL.findall(row):
            pay()
            wide, high = max(1, _span(attrs, "colspan")), max(1, _span(attrs, "rowspan"))
            at = len(cells)
            if at + wide > MOST_CELLS:
                raise TooLarge("a table's row is too wide")
            cells += [cell_text(inner), *[""] * (wide - 1)]
            if high > 1:
                for c in range(at, at + wide):
                    owed.setdefault(c, []).append(high - 1)
        pay()
        grid.append(cells)
    width = max(map(len, grid), default=0)
    if width * len(grid) > MOST_CELLS:
        raise TooLarge("a table is too large")
    return [row + [""] * (width - len(row)) for row in grid]


def to_gfm(source: str) -> str:
    grid = grid_of(source)
    if not grid:
        return ""
    head, *body = grid
    if head and head[0] == "":
        head[0] = "(header)"
    caption = _CAPTION.search(source)
    title = cell_text(caption[1]) if caption else ""
    rows = [head, ["---"] * len(head), *body]
    return "\n".join(([title] if title else []) + [f"| {' | '.join(r)} |" for r in rows])


def clamp_spans(source: str) -> str:
    """No column span beyond twice the cells of its row."""

    def row(m: re.Match) -> str:
        most = max(1, 2 * len(_CELL.findall(m[0])))
        return re.sub(r"(colspan\s*=\s*[\"']?)([0-9]+)", lambda a: a[1] + str(min(max(1, _number(a[2])), most)), m[0], flags=re.I)

    return re.sub(r"<tr\b[^>]*>[\s\S]*?</tr>", row, source, flags=re.I)


def with_tables(source: str) -> str:
    """Each table in place, as GFM text; one that is too large stays as it is."""

    def text(m: re.Match) -> str:
        try:
            return f"\n{to_gfm(m[0])}\n"
        except TooLarge:
            return m[0]

    return TABLE.sub(text, source)


def split_row(line: str) -> list[str] | None:
    """Cells of a GFM row, or None without a pipe. A backslash keeps the next character, and a pipe between equal runs of backticks is text."""
    if "|" not in line:
        return None
    cells, fence, at, border = [""], 0, 1 if line[0] == "|" else 0, False
    while at < len(line):
        border = False
        if line[at] == "\\":
            token = line[at : at + 2]
        elif line[at] == "`":
            token = re.match("`+", line[at:])[0]
            fence = 0 if fence == len(token) else fence or len(token)
        else:
            token = line[at]
            if token == "|" and not fence:
                cells.append("")
                token, border = "", True
                at += 1
        cells[-1] += token
        at += len(token)
    cells = [strip(c) for c in cells]
    if _ends_in_border(line) and cells[-1] == "":
        cells.pop()
    return cells


def _ends_in_border(line: str) -> bool:
    body = line[1:] if line[:1] == "|" else line
    slashes = len(body) - 1 - len(body[:-1].rstrip("\\"))
    return body.endswith("|") and slashes % 2 == 0


def _open_lines(lines: list[str]) -> Iterator[int]:
    """Numbers of the lines outside fenced code."""
    fence = None
    for i, line in enumerate(lines):
        mark = strip(line)[:3]
        if mark in ("```", "~~~"):
            fence = mark if fence is None else None if mark == fence else fence
        elif fence is None:
            yield i


def parse_gfm(markdown: str) -> list[list[str]] | None:
    """The first table of a text: a head of two cells or more, a delimiter row and at least one more row, all of one width."""
    lines = re.split(r"\r?\n", markdown)
    for i in _open_lines(lines[:-1]):
        head, rule = split_row(lines[i]), split_row(lines[i + 1])
        if not head or len(head) < 2 or not rule or len(rule) != len(head) or not all(re.fullmatch(":?-+:?", c) for c in rule):
            continue
        grid = [head]
        for line in lines[i + 2 :]:
            row = split_row(line)
            if not row or len(row) != len(head):
                break
            grid.append(row)
        if len(grid) > 1:
            return grid
    return None


def table_issues(markdown: str, spec: dict) -> list[str]:
    """What a text's first table lacks of the expected one: columns, rows, cells {"r,c": text}, same_row, same_column."""
    grid = parse_gfm(markdown)
    if grid is None:
        return [] if spec.get("require_markdown") is False else ["no table"]
    out = []
    if len(grid[0]) != spec["columns"]:
        out.append(f"{len(grid[0])} columns, not {spec['columns']}")
    if len(grid) != spec["rows"]:
        out.append(f"{len(grid)} rows, not {spec['rows']}")
    for key, want in (spec.get("cells") or {}).items():
        m = re.fullmatch(r"(\d+),(\d+)", key)
        if not m:
            out.append(f"bad cell key {key!r}")
            continue
        r, c = int(m[1]), int(m[2])
        got = grid[r][c] if r < len(grid) and c < len(grid[0]) else None
        if got != want:
            out.append(f"cell {key} is {got!r}, not {want!r}")
    where = lambda x: next(((r, c) for r, row in enumerate(grid) for c, cell in enumerate(row) if x in cell), None)
    for axis, name in ((0, "same_row"), (1, "same_column")):
        members = spec.get(name) or []
        places = [where(x) for x in members]
        for x, p in zip(members, places, strict=True):
            if places[0] is None:
                out.append(f"{name}: {members[0]!r} not found")
                break
            if p is None:
                out.append(f"{name}: {x!r} not found")
            elif p[axis] != places[0][axis]:
                out.append(f"{name}: {x!r} is elsewhere")
    return out
