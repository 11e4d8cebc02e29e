"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to the 256 code points of Latin-1, so that an Aho-Corasick automaton over strings
finds every vocabulary entry at every byte. The encoder walks from left to right, takes the longest
entry that starts at a position, and accepts it if merging would leave the border to the token
before it in place; otherwise it tries the next shorter entry, and steps back when none is left.
Positions proved dead are never tried again and the verdict on two adjacent tokens is remembered,
so work stays linear in the length of the text. The result is that of applying the merges by rank.

Defined results: null and empty texts have no ids; equal texts have equal ids; text of any length
is encoded whole; other columns of the input are not touched or returned.
"""

from __future__ import annotations

import base64
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from feedrank.llm.chunks import LONGEST, ChunkEncoder
from feedrank.llm.common import rows_of


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that remain of `piece` after merging, lowest rank first: the definition of BPE."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BacktrackingBpe:
    """An encoder and decoder for a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 1 << 19):
        self._ranks = ranks
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._parents: dict[int, tuple[int, int]] = {}
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                lower = {t: r for t, r in self._inner(token) if r < rank}
                parts = merge_by_rank(token, lower)
                if len(parts) != 2:
                    continue  # merging never makes it
                self._parents[rank] = (ranks[parts[0]], ranks[parts[1]])
            self._automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self._automaton.make_automaton()
        self._shorter: dict[int, int | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, bytes] = {}
        self._limit = limit
        self._pattern = regex.compile(public_tokenizers.PATTERN)

    def _inner(self, token: bytes):
        for i in range(len(token)):
            for j in range(i + 1, len(token) + 1):
                if (rank := self._ranks.get(token[i:j])) is not None:
                    yield token[i:j], rank

    def _next_shorter(self, token: int) -> int | None:
        """The longest entry that is a proper prefix of `token`."""
        if token not in self._shorter:
            text, found = self._bytes[token], None
            for end in range(len(text) - 1, 0, -1):
                rank = self._ranks.get(text[:end])
                if rank is not None and (end == 1 or rank in self._parents):
                    found = rank
                    break
            self._shorter[token] = found
        return self._shorter[token]

    def _stays(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves the border between them in place.

        The tokens are taken apart along the border, the one that was merged last first. A merge
        across the border would have come before what was taken apart if its rank is lower, or
        equal for a merge that stands further left.
        """
        a, b, before = left, right, 1 << 40
        while True:
            across = self._ranks.get(self._bytes[a] + self._bytes[b])
            if across is not None and across < before:
                return False
            open_a, open_b = a in self._parents, b in self._parents
            if not (open_a or open_b):
                return True
            if open_a and (a > b or not open_b):
                before, a = a, self._parents[a][1]
            else:
                before, b = b + 1, self._parents[b][0]

    def _compatible(self, left: int, right: int) -> bool:
        verdict = self._fits.get((left, right))
        if verdict is None:
            if len(self._fits) >= self._limit:
                self._fits.clear()
            verdict = self._fits[left, right] = self._stays(left, right)
        return verdict

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the splitting pattern."""
        whole = self._ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [0] * len(piece)
        for end, (rank, size) in self._automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend, so the last one is the longest
        size_of, dead = self._bytes, bytearray(len(piece) + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            end = at + len(size_of[token])
            if not dead[end] and (not ids or self._compatible(ids[-1], token)):
                ids.append(token)
                at = end
                token = longest[at] if at < len(piece) else 0
                continue
            shorter = self._next_shorter(token)
            while shorter is None:
                dead[at] = 1
                last = ids.pop()
                at -= len(size_of[last])
                shorter = self._next_shorter(last)
            token = shorter
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        parts = []
        for match in self._pattern.findall(text):
            ids = self._known.get(match)
            if ids is None:
                ids = np.array(self.encode_piece(match.encode()), dtype="<u4").tobytes()
                if len(match) <= LONGEST:
                    if len(self._known) >= self._limit:
                        self._known.clear()
                    self._known[match] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


@cache
def load(path: str) -> tuple[BacktrackingBpe, ChunkEncoder]:
    """The encoder for a file of ranks (a base64 token and its rank in each line); once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    bpe = BacktrackingBpe(ranks)
    return bpe, ChunkEncoder(bpe.encode, lambda chunks: list(map(bpe.encode, chunks)), limit=1 << 19)


def encode_decode(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the ids of its text (binary, little-endian unsigned 32-bit), their number, and
    the bytes they decode to. `ranks_path` must exist on every executor, as the libraries do."""

    def encode(batches):
        bpe, encoder = load(ranks_path)
        for rows in rows_of(batches):
            keys, ids = [r[0] for r in rows], [encoder.encode(r[1] or "") for r in rows]
            decoded = [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                ["doc_id", "n_tokens", "ids", "decoded"])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(encode, "doc_id long, n_tokens long, ids binary, decoded binary")
