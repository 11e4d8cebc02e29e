"""Words of many texts at once as arrays: their places and 64-bit hashes, and hashes of shingles.

Hashes only find candidates; whoever uses them compares the words themselves, or needs no more than a
choice that is the same for the same words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import xxhash

from feedrank.operators.bitmaps import bitmap, mixed, passing

__all__ = ["Texts", "bitmap", "grouped", "mixed", "passing", "shingles", "words_of"]

#: Bytes that are hashed at once; longer words are hashed by themselves.
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    inverse = np.full(BLOCK, pow(_BASE, -1, 1 << 64), np.uint64)
    base = np.full(BLOCK, _BASE, np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def _block(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, ends = edges[0::2], edges[1::2]
    powers, inverse = _powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts]), starts, ends


def words_of(data: bytes, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of `data`; `is_gap` tells for each of the 256 bytes whether it parts words."""
    raw = np.frombuffer(data, np.uint8)
    found, at = [], 0
    while at < len(raw):
        gap = is_gap[raw[at : at + BLOCK]]
        if at + BLOCK < len(raw):
            last = np.flatnonzero(gap)
            if not len(last):  # a word that fills the block
                more = is_gap[raw[at:]]
                end = at + (int(more.argmax()) if more.any() else len(more))
                digest = xxhash.xxh64_intdigest(data[at:end])
                found.append((np.array([digest], np.uint64), np.array([at]), np.array([end])))
                at = end
                continue
            gap = gap[: last[-1] + 1]
        elif len(gap) == BLOCK and not gap.any():
            digest = xxhash.xxh64_intdigest(data[at:])
            found.append((np.array([digest], np.uint64), np.array([at]), np.array([len(raw)])))
            break
        hashes, starts, ends = _block(raw[at : at + len(gap)], gap)
        found.append((hashes, starts + at, ends + at))
        at += len(gap)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*found))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every `size` words in a row."""
    n = max(len(hashes) - size + 1, 0)
    out = hashes[:n] + np.uint64(size)
    for k in range(1, size):
        out = mixed(out * np.uint64(_BASE) + hashes[k : n + k])
    return mixed(out)


class Texts:
    """The words of some texts: `data`, `hashes`, `starts`, `ends`, and `first`, the number of words before each text,
    with the number of all at its end."""

    def __init__(self, texts: list[bytes], table: bytes, is_gap: np.ndarray):
        self.data = b"\n".join(texts).translate(table)
        self.hashes, self.starts, self.ends = words_of(self.data, is_gap)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, begins)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and hashes of all shingles that lie in one text."""
        hashes = shingles(self.hashes, size)
        inside = np.flatnonzero(self.text[: len(hashes)] == self.text[size - 1 : size - 1 + len(hashes)])
        return inside, hashes[inside]

    def words(self, start: int, end: int) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist())]


def grouped(rows: Iterable[tuple], column: int, most: int = BLOCK) -> Iterator[list[tuple]]:
    """Rows some at a time, so that the texts in `column` have about `most` bytes together."""
    group, size = [], 0
    for row in rows:
        if group and size + len(row[column]) > most:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[column])
    if group:
        yield group
