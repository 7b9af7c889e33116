"""License scans: Aho-Corasick for notices and identifier tags, a shunting-yard parser for expressions.

A-Z are lower-cased and a text's words are its runs of digits, a-z and all that isn't ASCII. One automaton over
the words, joined by single spaces, finds every notice phrase and the words of an SPDX identifier tag. At a
tag the rest of the line is read as a licence expression (and binds closer than or, with closest).

score is what the text's licences permit, from 0 (nothing found) to 1 (permissive): `or` takes the larger side,
`and` the smaller, an exception (`with`) lifts its licence by 0.2, an unknown identifier has 0.1. All notices and
expressions of a text hold together, as with `and`.

Null text is empty and has no words. Long texts are scanned whole. Rows are independent: repeated rows repeat
their result, and an empty table gives an empty one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, small

# Notice phrases, families of licences and what they permit, beginnings of SPDX identifiers.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "bsd license": "bsd", "isc license": "isc", "zlib license": "zlib", "unlicense": "unlicense", "public domain": "public-domain",
    "boost software license": "boost", "mozilla public license": "mpl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "eclipse public license": "epl", "all rights reserved": "proprietary",
    "cc0": "cc0", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc", "cc by nc nd": "cc-by-nc", "creative commons zero": "cc0", "creative commons attribution noderivatives": "cc-by-nd",
    "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit", "licensed under the apache license": "apache",
    "permission to use copy modify and or distribute this software": "isc", "artistic license": "artistic",
    "common development and distribution license": "cddl", "european union public licence": "eupl", "open font license": "ofl", "python software foundation license": "psf",
    "academic free license": "afl", "open software license": "osl", "server side public license": "sspl", "business source license": "busl", "elastic license": "elastic",
    "open database license": "odbl", "microsoft public license": "ms-pl", "university of illinois ncsa open source license": "ncsa", "postgresql license": "postgresql",
    "php license": "php", "cecill": "cecill", "gnu free documentation license": "gfdl", "this is free and unencumbered software": "unlicense",
    "confidential and proprietary": "proprietary", "proprietary and confidential": "proprietary", "no license is granted": "proprietary",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
}
TAG = "spdx license identifier"
#: What a licence family permits.
PERMITS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "public-domain": 1.0, "boost": 1.0, "cc0": 1.0, "cc-by": 0.9,
    "mpl": 0.6, "lgpl": 0.6, "epl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.0,
    "wtfpl": 1.0, "artistic": 0.8, "cddl": 0.6, "eupl": 0.5, "ofl": 0.8, "psf": 1.0, "afl": 0.9, "osl": 0.4, "sspl": 0.1, "busl": 0.1, "elastic": 0.1, "odbl": 0.5, "ms-pl": 0.9,
    "ms-rl": 0.6, "ncsa": 1.0, "postgresql": 1.0, "php": 0.9, "cecill": 0.4, "gfdl": 0.4, "x11": 1.0, "openssl": 0.9, "w3c": 0.9, "ecl": 0.9, "pddl": 1.0, "curl": 1.0, "ruby": 0.8,
    "vim": 0.8, "libpng": 1.0, "ftl": 0.9, "icu": 1.0, "unicode": 1.0, "zpl": 0.9, "upl": 1.0, "blueoak": 1.0, "mulan": 1.0, "hpnd": 1.0, "ijg": 0.9, "cpl": 0.6, "ipl": 0.6, "qpl": 0.4, "spl": 0.6,
    "rpl": 0.3, "cpal": 0.5, "apsl": 0.5, "lppl": 0.7, "json": 0.8, "nist": 1.0, "prosperity": 0.2, "polyform": 0.2, "parity": 0.2, "intel": 0.9, "bittorrent": 0.5, "sleepycat": 0.4, "watcom": 0.4,
}
#: Beginnings of SPDX identifiers by family; the longest that fits counts.
FAMILIES = {
    "mit": "mit", "apache-": "apache", "bsd-": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "bsl-": "boost", "mpl-": "mpl",
    "lgpl-": "lgpl", "agpl-": "agpl", "gpl-": "gpl", "epl-": "epl", "cc0-": "cc0", "cc-by-": "cc-by", "cc-by-sa-": "cc-by-sa", "cc-by-nc-": "cc-by-nc", "cc-by-nd-": "cc-by-nd",
    "wtfpl": "wtfpl", "artistic-": "artistic", "clartistic": "artistic", "cddl-": "cddl", "eupl-": "eupl", "ofl-": "ofl", "psf-": "psf", "python-": "psf", "cnri-python": "psf", "afl-": "afl", "osl-": "osl",
    "sspl-": "sspl", "busl-": "busl", "elastic-": "elastic", "odbl-": "odbl", "odc-by-": "cc-by", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "ncsa": "ncsa", "postgresql": "postgresql", "php-": "php",
    "cecill-": "cecill", "cecill-b": "cecill", "gfdl-": "gfdl", "x11": "x11", "x11-": "x11", "mit-": "mit", "openssl": "openssl", "openssl-": "openssl", "w3c": "w3c", "w3c-": "w3c", "ecl-": "ecl", "pddl-": "pddl",
    "curl": "curl", "ruby": "ruby", "vim": "vim", "libpng": "libpng", "libpng-": "libpng", "zlib-": "zlib", "isc-": "isc", "ftl": "ftl", "icu": "icu", "unicode-": "unicode", "zpl-": "zpl", "upl-": "upl",
    "blueoak-": "blueoak", "mulanpsl-": "mulan", "hpnd": "hpnd", "hpnd-": "hpnd", "ijg": "ijg", "cpl-": "cpl", "ipl-": "ipl", "qpl-": "qpl", "spl-": "spl", "rpl-": "rpl", "cpal-": "cpal", "apsl-": "apsl",
    "lppl-": "lppl", "json": "json", "nist-": "nist", "prosperity-": "prosperity", "polyform-": "polyform", "parity-": "parity", "intel": "intel", "bittorrent-": "bittorrent", "sleepycat": "sleepycat",
    "watcom-": "watcom", "beerware": "wtfpl", "egpl-": "gpl", "nokia": "osl", "cc-pddc": "public-domain", "sax-pd": "public-domain", "libtiff": "mit", "ntp": "hpnd", "tcl": "bsd", "xnet": "mit", "aal": "bsd", "naumen": "bsd",
}
BINDS = {"or": 1, "and": 2, "with": 3}
#: The contract's character class: all other ASCII separates words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = "n_words long, matches array<struct<label:string,start_word:long,base:boolean>>, expressions array<string>, labels array<string>, score double"
MATCH = pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("base", pa.bool_())])
ARROW = pa.struct([("n_words", pa.int64()), ("matches", pa.list_(MATCH)), ("expressions", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())])


def family(identifier: str) -> str | None:
    fits = [p for p in FAMILIES if identifier == p or (p[-1] == "-" and identifier.startswith(p))]
    return FAMILIES[max(fits, key=len)] if fits else None


def parse_expression(text: str) -> list[str]:
    """The longest licence expression that text begins with, in postfix order; empty if there is none."""
    out, ops, best, operand = [], [], [], True
    for token in re.findall(r"[a-z0-9][a-z0-9.+\-]*|[()]|\S", text.lower()):
        if operand:  # an identifier or an opening bracket has to come
            if token == "(":
                ops.append(token)
                continue
            if token in BINDS or not token[0].isalnum():
                break
            out.append(token)
            operand = False
        elif token == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        elif token in BINDS:
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[token]:
                out.append(ops.pop())
            ops.append(token)
            operand = True
        else:
            break
        if not operand and "(" not in ops:
            best = out + ops[::-1]
    return best


def evaluate(postfix: list[str]) -> tuple[float, list[str], str]:
    """What the expression permits, its families, and itself with all brackets."""
    stack: list[tuple[float, list[str], str]] = []
    for token in postfix:
        if token not in BINDS:
            name = family(token)
            stack.append((PERMITS[name] if name else 0.1, [name] if name else [], token))
            continue
        (b, bs, bt), (a, as_, at) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((min(1.0, a + 0.2), as_, f"({at} with {bt})"))
        else:
            stack.append((max(a, b) if token == "or" else min(a, b), as_ + bs, f"({at} {token} {bt})"))
    return stack[0]


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        found.add_word(f" {phrase} ", (phrase, label))
    found.make_automaton()
    return found


def scan(text: str | None) -> dict:
    """The row of SCHEMA for one text."""
    raw = (text or "").encode()
    words = raw.translate(TABLE).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = [(end, *what) for end, what in automaton().iter(joined)] if words else []
    matches, expressions, level = [], [], []
    starts, seen, at = None, 0, 0
    for end, phrase, label in sorted(hits, key=lambda h: h[0] - len(h[1])):
        first = end - len(phrase) - 1  # the space before the phrase
        seen, at = seen + joined.count(" ", at, first), first
        if label:
            matches.append({"label": label, "start_word": seen, "base": phrase in BASE})
            level.append(PERMITS[label])
            continue
        if starts is None:  # where the words end in the text, for the few texts with a tag
            starts = [m.end() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
        line = re.match(rb"[ \t]*:[ \t]*([^\r\n]*)", raw[starts[seen + 2] :])
        if line and (postfix := parse_expression(line[1].decode("utf-8", "replace"))):
            value, names, shown = evaluate(postfix)
            expressions.append(shown)
            level.append(value)
            matches += [{"label": n, "start_word": seen, "base": False} for n in names]
    labels = sorted({m["label"] for m in matches})
    return {"n_words": len(words), "matches": matches, "expressions": expressions, "labels": labels, "score": min(level, default=0.0)}


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of SCHEMA for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = pa.array([scan(t.as_py()) for t in batch.column("text")], ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *rows.flatten()], names=["doc_id", *(f.name for f in ARROW)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id long, {SCHEMA}")


def op6_license_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start_word"])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda m: m["label"])))
    return license_scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join("expressions", "; ").alias("expressions"))


def _sql() -> str:
    """The query in SQL for texts without an identifier tag: what a tag's expression adds has no short form there, and is
    tested against random expression trees."""
    phrases = ", ".join(f"({label!r}, {str(phrase in BASE).lower()}, {phrase.split()!r}, {float(PERMITS[label])!r}::DOUBLE)" for phrase, label in {**NOTICES, **BASE}.items())
    return rf"""
WITH p(label, base, words, permits) AS (VALUES {phrases}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
m AS (SELECT u.doc_id, u.i, p.* FROM u JOIN p ON u.x = p.words[1] AND u.w[u.i + 1:u.i + len(p.words)] = p.words),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(permits) AS score FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score, '' AS expressions FROM d LEFT JOIN g USING (doc_id)
"""


OP6_SQL = _sql()
