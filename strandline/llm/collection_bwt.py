"""The Burrows-Wheeler transform and common prefixes of a collection, built column by column.

In round j the suffixes of length j of all texts enter the sorted collection at once. A suffix c + S goes where
the c before S stands among all c of the transform, so one stable sort of the transform by symbol gives every
place, and the prefix that it has in common with its neighbour is one more than the least common prefix between
theirs. Transform, common prefixes and names of suffixes lie in a file that every round reads and writes from
beginning to end."""

from __future__ import annotations

import tempfile

import numpy as np

#: An entry of the files. The symbol is an index into the collection's alphabet, END where a suffix is a whole text;
#: the common prefix with the entry before is kept up to 255.
ENTRY = np.dtype([("bwt", "u1"), ("lcp", "u1"), ("size", "u2"), ("text", "u4")])
END = 255


def build(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(entries of the suffixes in order, empty ones first; the alphabet). Texts of at most 65,535 bytes.

    Ends of texts are smaller than all symbols and differ."""
    m = len(texts)
    longest = max(map(len, texts), default=0)
    alphabet = np.unique(np.frombuffer(b"".join(texts), dtype=np.uint8))
    if longest > 65535 or len(alphabet) > END:
        raise ValueError("texts are too long, or use too many symbols")
    code = np.zeros(256, dtype=np.uint8)
    code[alphabet] = np.arange(len(alphabet))
    # Texts aligned to the right; row j holds the symbol that round j + 1 inserts.
    column = np.full((longest + 1, m), END, dtype=np.uint8)
    for i, t in enumerate(texts):
        column[: len(t), i] = code[np.frombuffer(t, dtype=np.uint8)[::-1]]
    with tempfile.TemporaryFile(prefix="bwt-") as file:
        entries = np.zeros(m, dtype=ENTRY)
        entries["bwt"], entries["text"] = column[0], np.arange(m)
        at, who = np.arange(m), np.arange(m)  # the suffixes of the last round: their places and texts
        for j in range(1, longest + 1):
            bwt, lcp = np.ascontiguousarray(entries["bwt"]), np.ascontiguousarray(entries["lcp"])
            going = bwt[at] != END
            at, who = at[going], who[going]
            symbol = bwt[at]
            by = np.argsort(symbol, kind="stable")
            at, who, symbol = at[by], who[by], symbol[by]
            counts = np.bincount(bwt, minlength=256)
            start = np.cumsum(counts) - counts
            order = np.argsort(bwt, kind="stable")[: len(bwt) - counts[END]]  # entries with a symbol, as their suffixes will stand
            g = np.empty(len(at), dtype=np.int64)
            lo = np.searchsorted(symbol, np.arange(END + 1))
            for c in np.flatnonzero(lo[1:] > lo[:-1]):
                g[lo[c] : lo[c + 1]] = start[c] + np.searchsorted(order[start[c] : start[c] + counts[c]], at[lo[c] : lo[c + 1]])
            before, after = order[np.maximum(g - 1, 0)], order[np.minimum(g + 1, len(order) - 1)]
            has_before = (g > 0) & (bwt[before] == symbol)
            has_after = (g + 1 < len(order)) & (bwt[after] == symbol)
            with_before = np.where(has_before, least(lcp, np.where(has_before, before, at - 1), at) + 1, 0)
            with_after = np.where(has_after, least(lcp, at, np.where(has_after, after, at + 1)) + 1, 0)
            new_at, total = m + g, m + len(order)
            new = np.empty(len(at), dtype=ENTRY)
            new["bwt"], new["lcp"], new["size"], new["text"] = column[j][who], np.minimum(with_before, 255), j, who
            old = np.ones(total, dtype=bool)
            old[new_at] = False
            merged = np.empty(total, dtype=np.uint64)
            merged[new_at] = new.view(np.uint64)
            merged[old] = entries.view(np.uint64)
            merged = merged.view(ENTRY)
            behind = new_at + 1 < total
            merged["lcp"][new_at[behind] + 1] = np.minimum(with_after, 255)[behind]
            file.seek(0)
            merged.tofile(file)
            file.flush()
            file.seek(0)
            entries = np.fromfile(file, dtype=ENTRY, count=total)
            at = new_at
    return entries, alphabet


def least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo + 1 : hi + 1] of each pair, lo < hi. Costs the ranges' lengths, which are short on average."""
    bounds = np.column_stack([lo + 1, hi + 1])
    order = np.argsort(lo, kind="stable")
    out = np.empty(len(lo), dtype=np.int64)
    padded = np.append(values, [0, 0])
    out[order] = np.minimum.reduceat(padded, bounds[order].ravel())[::2] if len(lo) else 0
    return out


def repeated(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, text, offset) of each substring of the length that stands more than once; groups are equal substrings."""
    entries, _ = build(texts)
    text = entries["text"].astype(np.int64)
    offset = np.array(list(map(len, texts)), dtype=np.int64)[text] - entries["size"]
    same = entries["lcp"] >= length
    group = np.cumsum(~same)
    member = same | np.append(same[1:], False)
    return group[member], text[member], offset[member]
