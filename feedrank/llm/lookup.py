"""Tables of numbers by key that documents look up where they are read, whatever the tables' size.

Entries are sorted by Spark, packed into arrays by its tasks and broadcast in parts of a bounded number of
entries; the driver and a task hold one part at a time. A task looks up the distinct keys of a batch of
documents, and every key is compared with the one that was asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedrank.llm.common import release, stored, stored_since, unused
from feedrank.operators.bitmaps import passing

#: Entries of a packed row, and keys of documents that are sorted at a time.
BLOCK = 1 << 19
Piece = tuple[int, np.ndarray, np.ndarray]


class Tables:
    """The entries (table, key, value) in this order."""

    def __init__(self, parts: list[Broadcast]):
        self.parts = parts

    def pieces(self) -> Iterator[Piece]:
        for part in self.parts:
            yield from part.value
            # A worker keeps the only part, but does not gather several.
            if len(self.parts) > 1 and getattr(part, "_path", None):
                part.__dict__.pop("_value", None)


def found(pieces: Iterator[Piece], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `keys` are in the `pieces` of one table, and their values, 0 for the others."""
    known, values = np.zeros(len(keys), bool), np.zeros(len(keys))
    for _, there, value in pieces:
        inside = np.flatnonzero((keys >= there[0]) & (keys <= there[-1]))
        at = np.searchsorted(there, keys[inside])
        same = there[at] == keys[inside]
        values[inside[same]] = value[at[same]]
        known[inside[same]] = True
    return known, values


def tables(entries: DataFrame, most: int) -> Tables:
    """The rows (table, key, value) of `entries` in parts of about `most`; keys are distinct in their table and not negative."""
    spark, mark, block = entries.sparkSession, len(stored_since(0)), min(BLOCK, most)

    def run(batches):
        waiting, size = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            table, key, value = (np.concatenate(c) for c in zip(*waiting))
            for t in np.unique(table):
                k, v = key[table == t], value[table == t]
                for i in range(0, len(k), block):
                    part = k[i : i + block].astype(np.uint64), v[i : i + block].astype(np.float32)
                    yield pa.RecordBatch.from_pylist([{
                        "table": int(t), "first": int(part[0][0]), "n": len(part[0]), "keys": part[0].tobytes(),
                        "values": part[1].tobytes()}], packed_schema)

        for batch in batches:
            waiting.append([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            size += batch.num_rows
            if size >= block:
                yield from rows()
                waiting, size = [], 0
        if size:
            yield from rows()

    packed_schema = pa.schema([("table", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
    typed = entries.select(F.col("table").cast("int"), F.col("key").cast("long"), F.col("value").cast("double"))
    ordered = stored(typed, "entries").repartitionByRange("table", "key").sortWithinPartitions("table", "key")
    packed = stored(ordered.mapInArrow(run, "table int, first long, n long, keys binary, values binary"), "packed")
    parts, size = [], 0
    for row in sorted(packed.select("table", "first", "n").collect()):
        if not parts or size + row["n"] > most:
            parts.append([])
            size = 0
        parts[-1].append(row)
        size += row["n"]
    place = F.struct("table", "first")
    out = []
    for part in parts:
        ends = [F.struct(F.lit(r["table"]).alias("table"), F.lit(r["first"]).cast("long").alias("first")) for r in (part[0], part[-1])]
        rows = packed.where((place >= ends[0]) & (place <= ends[1])).drop("n").collect()
        value = [(r["table"], np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["values"], np.float32)) for r in sorted(rows, key=lambda r: (r["table"], r["first"]))]
        out.append(spark.sparkContext.broadcast(value))
    release(spark, stored_since(mark))
    return Tables(out)


def scored(docs: DataFrame, keys_of: Callable[[str | None], Iterator[np.ndarray]], values_of: Callable[[np.ndarray], np.ndarray],
           text_column: str, likely: bytes | None = None) -> tuple[DataFrame, Column]:
    """`docs` with two more columns, the sum over all keys of a whole text of what `values_of` gives for them, and the number
    of keys; and the mean per key as a column of that. `values_of` gets distinct keys in order. A key that the bitmap `likely`
    rules out has the value 0 and is not looked up."""
    useful = None if likely is None else np.frombuffer(likely, np.uint8)
    total, units = unused(docs, "total", "units")
    added = T.StructType([T.StructField(total, T.DoubleType()), T.StructField(units, T.LongType())])
    place, names = docs.columns.index(text_column), [*docs.columns, total, units]

    def sums(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        blocks, waiting, owners, size = [], [], [], 0
        sum_, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)

        def block() -> tuple:
            distinct, inverse = np.unique(np.concatenate(waiting), return_inverse=True)
            return distinct, inverse.astype(np.int32), np.array(owners), np.array([len(w) for w in waiting])

        for i, text in enumerate(texts):
            for keys in keys_of(text.as_py()):
                count[i] += len(keys)
                if useful is not None:
                    keys = keys[passing(keys, useful)]
                if len(keys):
                    waiting.append(keys)
                    owners.append(i)
                    size += len(keys)
                if size >= BLOCK:
                    blocks.append(block())
                    waiting, owners, size = [], [], 0
        if waiting:
            blocks.append(block())
        if blocks:
            wanted = blocks[0][0] if len(blocks) == 1 else np.unique(np.concatenate([b[0] for b in blocks]))
            values = values_of(wanted)
            for distinct, inverse, owner, n in blocks:
                each = values[np.searchsorted(wanted, distinct)][inverse]
                np.add.at(sum_, owner, np.add.reduceat(each, np.cumsum(n) - n))
        return sum_, count

    def run(batches):
        for batch in batches:
            sum_, count = sums(batch.column(place))
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                new = [pa.array(sum_[start : start + 512], pa.float64()), pa.array(count[start : start + 512], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names)

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))
    return rows, F.col(total) / F.greatest(units, F.lit(1))
