"""A filter of fixed size for hashed keys, to leave out rows before a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 24


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bitmap(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> bytes:
    """A bit for each value of the low `bits` bits of the hashes: 2 MB by default, however many hashes there are. Of
    what it lets pass some was never in; the fuller it is, the more, but nothing that was in is lost."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = hashes.select(F.shiftright(slot, 6).cast("int").alias("word"), bit.alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.tobytes()


def passing(hashes: np.ndarray, filter_bits: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap, given as bytes, lets pass."""
    slot = hashes & np.uint64(len(filter_bits) * 8 - 1)
    return (filter_bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
