"""Interpolated modified Kneser-Ney models over byte n-grams, counted and estimated as Spark tables.

An n-gram of up to 7 bytes is a long: its bytes, the first one highest. So the context of n-gram `g` is
`g >> 8` and its ending without the first byte `g & mask`, and all counts are joined by plain keys, sharded
over the cluster. A context has at most 256 continuations, so the windows over contexts are small.

Counting and estimation are exact and cover all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedrank.llm.common import rows_of, stored

BLOCK = 1 << 20


def prepared(text: str | None, order: int) -> bytes:
    """Lower-case UTF-8 with single spaces, and `order - 1` more in front, so that every byte of it ends an n-gram.
    A blank text is one space."""
    words = (text or "").lower().encode().split()
    return b" " * order + b" ".join(words) + (b" " if words else b"")


def keys(data: bytes, order: int):
    """The n-grams of `data` in their order, in arrays of at most BLOCK: (all of `order` bytes)."""
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(whole) - order + 1, BLOCK):
        part = whole[start : start + BLOCK + order - 1].astype(np.uint64)
        n = len(part) - order + 1
        key = part[:n].copy()
        for i in range(1, order):
            key <<= np.uint64(8)
            key |= part[i : i + n]
        yield key


def counted(docs: DataFrame, order: int, flush: int = 1 << 22) -> DataFrame:
    """Rows (key, c0): how often each n-gram is in the texts of `docs` (text). Each task adds up what it has read
    before anything is shuffled, and passes it on before that gets large."""

    def run(batches):
        waiting, size = [], 0
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def added() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate(waiting), return_counts=True)
            keys_, place = np.unique(np.concatenate([known, new]), return_inverse=True)
            return keys_, np.bincount(place, np.concatenate([counts, times])).astype(np.int64)

        def record() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(counts)], ["key", "c0"])

        for rows in rows_of(batches):
            for (text,) in rows:
                parts = list(keys(prepared(text, order), order))
                waiting += parts
                size += sum(map(len, parts))
            if size >= flush:
                known, counts = added()
                waiting, size = [], 0
                if len(known) >= flush:
                    yield record()
                    known, counts = known[:0], counts[:0]
        if waiting:
            known, counts = added()
        yield record()

    return docs.mapInArrow(run, "key long, c0 long").groupBy("key").agg(F.sum("c0").alias("c0"))


def discounts(counts: DataFrame, column: str) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts of one, two, and three or more."""
    row = counts.agg(*(F.sum((F.col(column) == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
    n = [float(row[f"n{i}"] or 0) for i in (1, 2, 3, 4)]
    if not n[0]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    found = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i for i in (1, 2, 3)]
    return tuple(min(max(d, 0.05), 0.95 * i) for i, d in zip((1, 2, 3), found))


def taken(count: Column, discount: tuple[float, float, float]) -> Column:
    """What is discounted from a count."""
    one, two, more = discount
    return F.when(count >= 3, F.lit(more)).when(count == 2, F.lit(two)).when(count == 1, F.lit(one)).otherwise(F.lit(0.0))


def shorter(counts: DataFrame, order: int) -> DataFrame:
    """From the n-grams of `order`, rows (key, c0) of `order - 1`: how many different bytes come before it."""
    mask = (1 << 8 * (order - 1)) - 1
    return counts.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.count(F.lit(1)).alias("c0"))


def continuation(counts: DataFrame, order: int) -> list[DataFrame]:
    """Stored tables of orders 1 to `order` as `interpolated` makes them, from continuation counts. `counts` (key) is
    the table of order + 1."""
    tables = {}
    for k in range(order, 0, -1):
        counts = tables[k] = stored(shorter(counts, k + 1), f"continuation{k}")
    out = []
    for k in range(1, order + 1):
        out.append(stored(interpolated(tables[k], k, out[-1] if out else None), f"order{k}"))
    return out


def interpolated(counts: DataFrame, order: int, below: DataFrame | None) -> DataFrame:
    """Rows (key, c0, context, p, gamma) from the counts (key, c0) of one order: the interpolated probability of the last byte
    after the context, and the share that the context leaves to shorter ones. `below`: the order below; None for bytes."""
    context, count = Window.partitionBy("context"), F.col("c0")
    less = taken(count, discounts(counts, "c0"))
    total = F.sum(count).over(context)
    rows = counts.withColumn("context", F.shiftrightunsigned("key", 8)).select(
        "key", "c0", "context", ((count - less) / total).alias("own"), (F.sum(less).over(context) / total).alias("gamma"))
    if below is None:
        rows = rows.withColumn("q", F.lit(1 / 256))
    else:
        lower = below.select(F.col("key").alias("ending"), F.col("p").alias("q"))
        mask = (1 << 8 * (order - 1)) - 1
        rows = rows.join(lower, F.col("key").bitwiseAND(F.lit(mask)) == F.col("ending"))
    return rows.select("key", "c0", "context", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"), "gamma")
