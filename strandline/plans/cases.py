"""Small inputs with their answers, worked out by hand from the rules: tables in text, requests over a transcript, URLs."""

from __future__ import annotations


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """SQL of literal rows."""
    cell = lambda x: quoted(x) if isinstance(x, str) or x is None else str(x).lower() if isinstance(x, bool) else str(x)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({names})"


#: Text, the expected table (columns, rows, cells, same row, same column, required), and what the text's first table lacks of it.
TABLES = [
    ("| a | b |\n| --- | --- |\n| 1 | 2 |", (2, 2, {"0,0": "a", "1,1": "2"}, ["1", "2"], ["b", "2"], None), ""),
    ("a | b\n:-- | --:\n1 | 2", (2, 2, {"1,0": "1"}, None, None, None), ""),
    ("| a | b |\n| --- | --- |\n| 1 | 2 |", (3, 4, {}, None, None, None), "2 columns, not 3; 2 rows, not 4"),
    ("| a | b |\n| --- | --- |\n| x\\|y | `p|q` |", (2, 2, {"1,0": "x\\|y", "1,1": "`p|q`"}, None, None, None), ""),
    ("```\n| a | b |\n| --- | --- |\n| 1 | 2 |\n```\n| c | d |\n|-|-|\n| 3 | 4 |", (2, 2, {"0,0": "c"}, None, None, None), ""),
    ("no table here", (2, 2, {}, None, None, None), "no table"),
    ("| a | b |\n| --- | --- |\n| 1 | 2 |", (2, 2, {"bad": "y"}, ["zz", "1"], None, None), "bad cell key 'bad'; same_row: 'zz' not found"),
    ("no table here", (2, 2, {}, None, None, False), ""),
    ("| a | b |\n| --- |\n| 1 | 2 |", (2, 2, {}, None, None, None), "no table"),
    ("| a |\n| --- |\n| 1 |", (1, 2, {}, None, None, None), "no table"),
    ("| a | b |\n| --- | --- |", (2, 1, {}, None, None, None), "no table"),
    ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |\n| 5 | 6 |", (2, 2, {"1,1": "2"}, None, None, None), ""),
    ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", (2, 3, {"9,9": "x"}, ["1", "4"], ["a", "zz"], None), "cell 9,9 is None, not 'x'; same_row: '4' is elsewhere; same_column: 'zz' not found"),
]

U = "http://t.test"
#: The transcript: path, visit, status, location or retry-after, error.
ANSWERS = [
    ("/ok", 1, 200, None, None), ("/404", 1, 404, None, None), ("/500", 1, 500, None, None), ("/429", 1, 429, None, None), ("/a/b", 1, 302, "sibling", None), ("/a/sibling", 1, 200, None, None), ("/l1", 1, 302, "/l2", None),
    ("/l2", 1, 301, "/l1", None), ("/ftp", 1, 302, "ftp://x.test/", None), ("/none", 1, 302, None, None), ("/304", 1, 304, None, None), ("/flaky", 1, 503, "9999", None), ("/flaky", 2, 200, None, None), ("/down", 1, 503, None, None),
    ("/r", 1, 307, "/flaky", None), ("/slow", 1, None, None, "HeadersTimeoutError"), ("/stuck", 1, None, None, "BodyTimeoutError"), ("/cut", 1, None, None, "SocketError"), *[(f"/h{i}", 1, 302, f"/h{i + 1}", None) for i in range(7)], ("/h7", 1, 200, None, None),
]
#: Of each request: reason, status, requests, attempts, URLs of the chain, final path, milliseconds waited, events.
ENDS = [
    ("/ok", None, 200, 1, 1, 1, "/ok", 0.0, "request_complete"), ("/404", None, 404, 1, 1, 1, "/404", 0.0, "request_complete"), ("/500", None, 500, 1, 1, 1, "/500", 0.0, "request_complete"),
    ("/429", None, 429, 1, 1, 1, "/429", 0.0, "request_complete"), ("/a/b", None, 200, 2, 1, 2, "/a/sibling", 0.0, "request_complete redirect request_complete"),
    ("/l1", "redirect_loop", 301, 2, 1, 2, "/l1", 0.0, "request_complete redirect request_complete redirect_loop"), ("/ftp", "policy_denied", 302, 1, 1, 1, "/ftp", 0.0, "request_complete redirect_policy_denied"),
    ("/none", "http_error", 302, 1, 1, 1, "/none", 0.0, "request_complete"), ("/304", "http_error", 304, 1, 1, 1, "/304", 0.0, "request_complete"), ("/flaky", None, 200, 2, 2, 1, "/flaky", 2000.0, "request_complete retry request_complete"),
    ("/down", None, 503, 2, 2, 1, "/down", 0.0, "request_complete retry request_complete"), ("/r", None, 200, 3, 2, 2, "/flaky", 2000.0, "request_complete redirect request_complete retry request_complete"),
    ("/slow", "timeout", None, 1, 1, 1, "/slow", 0.0, "request_failed"), ("/stuck", "timeout", None, 1, 1, 1, "/stuck", 0.0, "request_failed"), ("/cut", "connection_error", None, 1, 1, 1, "/cut", 0.0, "request_failed"),
    ("/h0", "redirect_limit", 302, 6, 1, 6, "/h5", 0.0, "request_complete redirect " * 5 + "request_complete redirect_limit"), ("/h2", None, 200, 6, 1, 6, "/h7", 0.0, "request_complete redirect " * 5 + "request_complete"),
    ("/missing", "connection_error", None, 1, 1, 1, "/missing", 0.0, "request_failed"),
]
#: Base, location, and the URL that is meant.
URLS = [
    ("http://h.test/a/b", "c", "http://h.test/a/c"), ("http://h.test/a/b", "/c?d#e", "http://h.test/c?d#e"), ("http://h.test/a/b", "../../c", "http://h.test/c"), ("http://h.test/a/b?q", "?r", "http://h.test/a/b?r"),
    ("https://h.test/a", "//o.test/p", "https://o.test/p"), ("http://h.test/a", "https://o.test", "https://o.test/"), ("http://h.test/a", "  /z ", "http://h.test/z"), ("http://h.test/a/b", "..\\c", "http://h.test/c"),
    ("http://h.test/a", "/x\n/y\t", "http://h.test/x/y"), ("http://h.test/a", "mailto:me@x.test", "mailto:me@x.test"), ("http://h.test/a", "", None), ("http://h.test/a", "http://[", None), ("http://h.test/a", "http://", None), ("http://h.test/a", "https:///o.test//p", "https://o.test//p"),
]
