"""Sets of five-word shingles as sorted arrays of 64-bit hashes.

A-Z are lower-cased; words are runs of bytes other than space and the controls from tab to carriage return.
A text with fewer words than five has its whole sequence as its one shingle; without words the set is empty.
Hashes only ever stand for shingles within one pair of documents, where a collision has a chance of about
n^2 / 2^64. A word's hash is a polynomial modulo 2^64; words of LONG bytes or more, among which some collide whatever the
base is, get a digest of their bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

WIDTH, LONG = 5, 256
#: Bytes worked on at once.
PIECE = 1 << 18
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MULT = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _bytes() -> np.ndarray:
    """A random number for each byte; capitals have that of their small letter."""
    out = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    out[65:91] = out[97:123]
    return out


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of data, and where it starts."""
    a = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([[False], ~_SEP[a], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(1 << max(19, len(a).bit_length()))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_bytes()[a] * up[: len(a)], dtype=np.uint64)])
    out = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].lower(), digest_size=8).digest(), "little")
    return out, start


def pieces(texts: list[str | None]) -> Iterator[list[tuple[int, bytes]]]:
    """(index, UTF-8) of the texts in batches of about PIECE bytes; a longer text is a batch of its own."""
    batch, size = [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if batch and size + len(data) > PIECE:
            yield batch
            batch, size = [], 0
        batch.append((i, data))
        size += len(data) + 1
    if batch:
        yield batch


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint64)] * len(texts)
    for batch in pieces(texts):
        words, start = word_hashes(b"\n".join(d for _, d in batch))
        ends = np.cumsum([len(d) + 1 for _, d in batch])
        bound = np.concatenate([[0], np.searchsorted(start, ends)])
        n = len(words)
        joined = np.zeros(max(n - WIDTH + 1, 0), dtype=np.uint64)
        for i in range(WIDTH):
            joined += words[i : n - WIDTH + 1 + i] * _MULT[i] if n >= WIDTH else 0
        joined = mixed(joined)
        for (i, _), lo, hi in zip(batch, bound[:-1], bound[1:], strict=True):
            if hi - lo >= WIDTH:
                out[i] = np.unique(joined[lo : hi - WIDTH + 1])
            elif hi > lo:
                short = (words[lo:hi] * _MULT[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                out[i] = mixed(np.array([short], dtype=np.uint64))
    return out
