"""Order-preserving packing of documents into training sequences by dynamic programming.

A partition's documents, in the order in which they come, form one stream of ids. It is cut into
windows of at most `size` ids. A window that is shorter costs its padding, unless its length is a
power of two, which needs none; a cut inside a document costs a penalty, a smaller one where a
sentence ends. With `best[j]` the least cost of a stream that ends at place j,

    best[j] = penalty[j] + min over i of best[i] + padding(place[j] - place[i]).

Padding falls by one for each id, so the minimum over all windows is that of `best[i] + place[i]`
over a sliding range, which a monotone queue gives in constant time; windows of a power of two are
looked up beside it. Places are document ends, sentence ends, and every `size` ids where neither
comes for that long. The stream is decided block by block: of each block all windows but the last
few are final, and the rest is decided again with what follows, so memory does not grow with the
partition. Nothing is shuffled; each partition ends with windows of powers of two, without padding.

Defined results: a null or empty text is a document of its end id alone; repeated rows are packed
each for itself; an empty table gives no rows; a document longer than a window is cut; other
columns are neither read nor returned; of cuts that cost the same, the one with the longest window
is taken, unless a window of a power of two is as cheap.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from feedrank.llm import tokens
from feedrank.llm.common import rows_of

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


@dataclass(frozen=True)
class Packing:
    """`sentence_cut` and `free_cut`: what a cut there costs, in ids of padding. `block`: ids decided at
    once; `undecided`: windows at its end that are decided again."""

    size: int = 2048
    end_id: int = 1
    sentence_cut: int = 4
    free_cut: int = 64
    block: int = 1 << 20
    undecided: int = 16


def padding(length: int, size: int) -> int:
    """A sequence is padded to `size`, unless its length is a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def choose_cuts(places: np.ndarray, penalties: np.ndarray, size: int) -> list[int]:
    """Which of the ascending `places` (the first is the start, the last the end of the stream) to cut
    at, at least cost. No two neighbours are further apart than `size`."""
    position, penalty = places.tolist(), penalties.tolist()
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    exact: dict[int, list[int]] = {}
    for power in powers:
        wanted = places - power
        found = np.searchsorted(places, wanted).clip(0, len(places) - 1)
        for j in np.flatnonzero(places[found] == wanted).tolist():
            exact.setdefault(j, []).append(int(found[j]))
    best, back = [0] * len(position), [0] * len(position)
    queue = deque([(position[0], 0)])  # of (best + place, index), ascending
    for j in range(1, len(position)):
        here = position[j]
        while position[queue[0][1]] < here - size:
            queue.popleft()
        cost, back[j] = queue[0][0] + size - here, queue[0][1]
        for i in exact.get(j, ()):
            if best[i] < cost:
                cost, back[j] = best[i], i
        best[j] = cost + penalty[j]
        key = best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [len(position) - 1], len(position) - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def _places(ends: np.ndarray, sentence: np.ndarray, total: int, size: int) -> np.ndarray:
    """All places to cut at, filled up where there is none for `size` ids."""
    places = np.unique(np.concatenate([[0], ends, sentence, [total]]))
    gaps = np.diff(places)
    if len(gaps) and gaps.max() > size:
        more = [np.arange(a + size, b, size) for a, b in zip(places[:-1][gaps > size], places[1:][gaps > size])]
        places = np.unique(np.concatenate([places, *more]))
    return places


class _Stream:
    """Documents of one partition that are not yet cut, and the windows that are."""

    def __init__(self, packing: Packing, is_end: np.ndarray, first_sequence: int):
        self.packing, self.is_end, self.sequence = packing, is_end, first_sequence
        self.docs: deque[list] = deque()  # key, ids, ids of it that are already in a window
        self.waiting = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.docs.append([key, ids, 0])
        self.waiting += len(ids)

    def cut(self, final: bool) -> Iterator[tuple]:
        """Pieces of the windows that are decided; all of them if `final`."""
        if not self.waiting:
            return
        p = self.packing
        ids = np.concatenate([doc[1][doc[2]:] for doc in self.docs])
        ends = np.cumsum([len(doc[1]) - doc[2] for doc in self.docs])
        sentence = np.flatnonzero(self.is_end[ids]) + 1
        total = len(ids)
        if final:  # binary places of the rest, so that the last windows need no padding
            powers = np.array([1 << k for k in range(p.size.bit_length()) if total % p.size >> k & 1], np.int64)
            tail = total - np.cumsum(powers)
            sentence = np.concatenate([sentence, tail[tail > 0]])
        places = _places(ends, sentence, total, p.size)
        penalties = np.full(len(places), p.free_cut)
        penalties[np.isin(places, np.flatnonzero(self.is_end[ids]) + 1)] = p.sentence_cut
        penalties[np.isin(places, ends)] = 0
        cuts = places[choose_cuts(places, penalties, p.size)]
        if not final:
            cuts = cuts[: max(2, len(cuts) - p.undecided)]
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield from self._window(end - start)

    def _window(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            key, ids, start = self.docs[0]
            take = min(length - offset, len(ids) - start)
            crc = zlib.crc32(ids[start : start + take].tobytes())
            yield key, start, take, crc, len(ids), self.sequence, offset
            offset += take
            self.docs[0][2] += take
            if self.docs[0][2] == len(ids):
                self.docs.popleft()
        self.waiting -= length
        self.sequence += 1


def _record(pieces: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in PIECES.split(", ")]
    columns = list(zip(*pieces)) if pieces else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, tokenizer_path: str, packing: Packing = Packing(), id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence. `start` counts the ids of the document before
    the piece, `offset` those of the sequence; `ids_crc32` is over little-endian unsigned 32-bit ids.
    Sequence ids are unique: the partition's number in the upper bits, a counter in the lower 36."""

    def run(batches):
        encode, is_end = tokens.load(tokenizer_path)
        stream = _Stream(packing, np.append(is_end, False), TaskContext.get().partitionId() << 36)
        end = np.array([packing.end_id], dtype="<u4").tobytes()
        for rows in rows_of(batches):
            for key, text in rows:
                stream.add(key, np.frombuffer(encode(text or "") + end, dtype="<u4"))
            if stream.waiting >= packing.block:
                yield _record(list(stream.cut(final=False)))
        yield _record(list(stream.cut(final=True)))

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(run, PIECES)
