"""Training-order materialisation: every sequence of token ids at a global slot, in shards of fixed stride.

Documents are encoded and cut into sequences of `size` ids. Sequences are numbered from 0 to n - 1 in the order of
the partitions that made them, and a keyed Feistel permutation of the numbers gives each its slot: four-round networks over
the smallest even number of bits that holds n, walked along their cycle until they land below n again.
So the order is random, reproducible from the key, computed without a sort, and any slot can be
computed back. A shard holds `per_shard` consecutive slots, in order, each as a record of the same
number of bytes: record i of shard s is slot s * per_shard + i, at byte i * stride. A reader resumes with one
division, and shards are written and checked apart from each other.

A record is a header (slot, document and position in it of the first id: signed 64-bit; number of ids, CRC-32 of the
padded ids: unsigned 32-bit), `size` ids as unsigned 16-bit, zero after the last, and a line feed; all little-endian.
Vocabularies beyond 65,536 ids raise.

Defined results: null and empty texts are documents of the end id alone; repeated rows are written each for itself; an
empty table writes no shard; only the last sequence of a partition is short; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedrank.llm import tokens
from feedrank.llm.common import rows_of

HEADER = "<qqqII"
#: Stands for a null document id in a header.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Shards:
    size: int = 2048
    end_id: int = 1
    per_shard: int = 4096
    key: int = 20240131
    rounds: int = 4

    @property
    def stride(self) -> int:
        return struct.calcsize(HEADER) + 2 * self.size + 1


def sequences(docs: DataFrame, tokenizer_path: str, shards: Shards = Shards(), id_column: str = "doc_id",
              text_column: str = "text") -> DataFrame:
    """Rows (part, place, doc_id, start, n_ids, ids): the stream of each partition in pieces of `size` ids."""

    def run(batches):
        encode, ends = tokens.load(tokenizer_path)
        if len(ends) > 1 << 16:
            raise ValueError("the vocabulary has more ids than 16 bits hold")
        part, place, size = TaskContext.get().partitionId(), 0, shards.size
        end = np.array([shards.end_id], dtype="<u2")
        waiting: list[tuple] = []  # (document, start, ids)
        held = 0

        def emit(final: bool) -> pa.RecordBatch:
            nonlocal waiting, held, place
            stream = np.concatenate([w[2] for w in waiting]) if waiting else end[:0]
            count = -(-held // size) if final else held // size
            begins = np.cumsum([0, *(len(w[2]) for w in waiting)])
            at = np.searchsorted(begins, np.arange(count) * size, side="right") - 1
            cut = [stream[i * size : (i + 1) * size] for i in range(count)]
            batch = pa.RecordBatch.from_arrays([
                pa.array([part] * count, pa.int32()), pa.array(range(place, place + count), pa.int64()),
                pa.array([waiting[j][0] for j in at], pa.int64()),
                pa.array([waiting[j][1] + i * size - int(begins[j]) for i, j in enumerate(at)], pa.int64()),
                pa.array([len(c) for c in cut], pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary()),
            ], ["part", "place", "doc_id", "start", "n_ids", "ids"])
            place += count
            used = min(count * size, held)
            if used < held:
                j = int(np.searchsorted(begins, used, side="right")) - 1
                skip = used - int(begins[j])
                key, start, ids = waiting[j]
                waiting = [(key, start + skip, ids[skip:]), *waiting[j + 1 :]]
            else:
                waiting = []
            held -= used
            return batch

        for rows in rows_of(batches):
            for key, text in rows:
                ids = np.append(np.frombuffer(encode(text or ""), "<u4").astype("<u2"), end)
                waiting.append((key, 0, ids))
                held += len(ids)
            if held >= 256 * size:
                yield emit(final=False)
        yield emit(final=True)

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(run, "part int, place long, doc_id long, start long, n_ids int, ids binary")


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    """A keyed hash of 64-bit values."""
    x = half + np.uint64(key & (1 << 64) - 1)
    for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ x >> np.uint64(30)) * np.uint64(multiplier)
    return x ^ x >> np.uint64(31)


def permuted(numbers: np.ndarray, total: int, key: int, rounds: int = 4, back: bool = False) -> np.ndarray:
    """The slots of `numbers`, all from 0 to total - 1; with `back`, the numbers of slots."""
    half = np.uint64(max(1, -(-max(total - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 for r in range(rounds)]

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mixed(left, k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, k) & mask)
        return left << half | right

    out = network(numbers.astype(np.uint64))
    while (outside := out >= total).any():
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def dealt(pieces: DataFrame, shards: Shards = Shards()) -> DataFrame:
    """Rows (shard, heads, bodies) for stored `pieces`: what each task has for a shard, packed and compressed, so that
    the shuffle moves little more than the entropy of the ids. The driver sees one count per partition."""
    counts = sorted(pieces.groupBy("part").count().collect())
    total, before = 0, {}
    for part, count in counts:
        before[part], total = total, total + count
    offsets = pieces.sparkSession.sparkContext.broadcast(before)
    names = ["shard", "heads", "bodies"]

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = batch.to_pydict()
            number = np.array([offsets.value[p] + i for p, i in zip(data["part"], data["place"])], np.int64)
            slot = permuted(number, total, shards.key, shards.rounds) if len(number) else number
            shard, out = slot // shards.per_shard, []
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                heads = np.array([
                    (slot[i], NO_ID if data["doc_id"][i] is None else data["doc_id"][i], data["start"][i], data["n_ids"][i])
                    for i in own], "<i8")
                bodies = packer.compress(b"".join(data["ids"][i].ljust(2 * shards.size, b"\0") for i in own))
                out.append((int(shard[own[0]]), heads.tobytes(), bodies))
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return pieces.mapInArrow(run, "shard int, heads binary, bodies binary")


def records(parts: DataFrame, shards: Shards = Shards()) -> DataFrame:
    """Rows (shard, slot, record) from what `dealt` made: a shard, `per_shard` records, is put together by one task."""
    size = 2 * shards.size

    def build(table: pa.Table) -> pa.Table:
        unpacker, rows = zstandard.ZstdDecompressor(), []
        for heads, bodies in zip(table.column("heads").to_pylist(), table.column("bodies").to_pylist()):
            ids = unpacker.decompress(bodies)
            for i, (slot, doc, start, n) in enumerate(np.frombuffer(heads, "<i8").reshape(-1, 4).tolist()):
                body = ids[i * size : (i + 1) * size]
                rows.append((slot, struct.pack(HEADER, slot, doc, start, n, zlib.crc32(body)) + body))
        shard = table.column("shard")[0].as_py()
        slots, made = zip(*sorted(rows))
        return pa.table({"shard": pa.array([shard] * len(rows), pa.int32()), "slot": pa.array(slots, pa.int64()),
                         "record": pa.array(made, pa.binary())})

    return parts.groupBy("shard").applyInArrow(build, "shard int, slot long, record binary")


def write(pieces: DataFrame, path: str, shards: Shards = Shards(), only: list[int] | None = None) -> None:
    """Write the shards under `path`, or those in `only` again, as `shard=N/part-*`: one file each, made by one
    task, so that a lost executor costs no more than its shards."""
    parts = dealt(pieces, shards)
    if only is not None:
        parts = parts.where(F.col("shard").isin(only))
    ordered = records(parts, shards).sortWithinPartitions("shard", "slot")
    # The text writer copies bytes as they are and ends each record with a line feed, on any file system of Spark's.
    lines = ordered.select(F.col("record").cast("string").alias("value"), "shard")
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").text(path)


def read(spark: SparkSession, path: str, shards: Shards = Shards(), shard: int | None = None, first: int = 0) -> DataFrame:
    """Rows (slot, shard, place, doc_id, start, n_ids, intact, ids) of all shards, or of one shard from record `first` on."""
    size, per_shard = shards.size, shards.per_shard

    def parsed(record: bytes):
        slot, doc, start, n, crc = struct.unpack_from(HEADER, record)
        body = record[struct.calcsize(HEADER) : struct.calcsize(HEADER) + 2 * size]
        return (slot, slot // per_shard, slot % per_shard, None if doc == NO_ID else doc, start, n,
                zlib.crc32(body) == crc, body[: 2 * n])

    folder = f"{path}/shard={'*' if shard is None else shard}"
    schema = "slot long, shard long, place long, doc_id long, start long, n_ids int, intact boolean, ids binary"
    pattern = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
        return spark.createDataFrame([], schema)
    rows = spark.sparkContext.binaryRecords(folder, shards.stride).map(parsed)
    out = spark.createDataFrame(rows, schema)
    return out.where(F.col("place") >= first) if first else out


def unfinished(spark: SparkSession, path: str, total: int, shards: Shards = Shards()) -> list[int]:
    """The shards of `total` sequences that are missing or don't have their full length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    number = F.regexp_extract("path", "/shard=([0-9]+)/", 1).cast("int")
    sizes = dict(files.groupBy(number.alias("shard")).agg(F.sum("length")).collect())
    count = -(-total // shards.per_shard)
    due = [min(shards.per_shard, total - i * shards.per_shard) * shards.stride for i in range(count)]
    return [i for i in range(count) if sizes.get(i) != due[i]]
