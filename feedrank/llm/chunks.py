"""Byte-pair encoding of whole texts by way of remembered chunks.

The splitting pattern of the tokenizers never lets a token run across the border before a single
space, or on either side of a single line feed, that stands between two other characters that are
no white space. Texts in which white space occurs only like that are cut there, and what a chunk
encodes to is looked up. Texts with other white space are encoded whole, without the memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_LOOSE = re.compile(r"\s\s|\A\s|\s\Z|\x00")
#: Longer chunks are rare and would fill the memory.
LONGEST = 48


def pieces(text: str) -> list[str] | None:
    """`text` cut at borders that no token crosses; None if it has to be encoded whole."""
    if _LOOSE.search(text):
        return None
    return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")


class ChunkEncoder:
    """Encodes texts with `whole`, which gives the bytes of a text's ids, and `chunks`, which does so for a list
    of chunks; remembers up to `limit` chunks (then the memory is dropped: results don't depend on it)."""

    def __init__(self, whole: Callable[[str], bytes], chunks: Callable[[list[str]], list[bytes]], limit: int = 1 << 20):
        self._whole, self._chunks, self._limit, self._known = whole, chunks, limit, {}

    def encode(self, text: str) -> bytes:
        """The ids of `text` as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        chunks = pieces(text)
        if chunks is None:
            return self._whole(text)
        found = list(map(self._known.get, chunks))
        if None in found:
            missing = list(dict.fromkeys(c for c, ids in zip(chunks, found) if ids is None))
            new = dict(zip(missing, self._chunks(missing)))
            found = [new[c] if ids is None else ids for c, ids in zip(chunks, found)]
            if len(self._known) + len(new) > self._limit:
                self._known.clear()
            self._known.update((c, ids) for c, ids in new.items() if len(c) <= LONGEST)
        return b"".join(found)
