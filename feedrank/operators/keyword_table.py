"""Keyword hits where the keywords are a table of any size.

A text contains a keyword only if it contains all of the keyword's grams (four bytes in a row), so an index of grams finds
candidates: each keyword is filed under that of its grams which is rarest in the texts, and texts are joined with the keywords by
the grams they hold. The place of the gram tells where in the text the keyword would stand, and there the bytes are compared.
A keyword of more than BLOCK bytes is filed in blocks, each under a gram of its own, and is found where all blocks are.
Lower-casing is Spark's; bytes of UTF-8 match where characters do.

Texts are scanned twice, to count the grams of the keywords and to find the chosen ones. A filter of 2 MB of bits leaves out
all other places of a text before anything is shuffled, and what goes on is a place with at most 2 * BLOCK bytes around it.
Neither texts nor keywords are broadcast, unless Spark finds the keywords small; a keyword that is in very many texts makes
narrow rows that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.operators.bitmaps import bitmap, mixed, passing
from feedrank.session import stored

GRAM, BLOCK = 4, 32
_STEP = 1 << 20  # bytes of text looked at at a time


def _grams(raw: np.ndarray, size: int) -> np.ndarray:
    """The grams of `size` bytes at every place, as numbers that hold the bytes and the size."""
    n = max(len(raw) - size + 1, 0)
    out = np.full(n, size << 32, np.int64)
    for k in range(size):
        out |= raw[k : n + k].astype(np.int64) << (8 * k)
    return out


def _hashed(grams: np.ndarray) -> np.ndarray:
    return mixed(grams.view(np.uint64))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """Batches of a few texts, their bytes in a row, and where each begins, with the end of the last."""
    for batch in batches:
        sizes = np.array([len(t) for t in batch.column("__text").to_pylist()], np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), _STEP, "right")))
            part = batch.slice(start, stop - start)
            yield part, b"".join(part.column("__text").to_pylist()), np.cumsum([0, *sizes[start:stop]])
            start = stop


def _places(data: bytes, begins: np.ndarray, sizes: Sequence[int], useful: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, gram, size) arrays for the grams inside one text that the filter lets pass."""
    raw = np.frombuffer(data, np.uint8)
    for size in sizes:
        for at in range(0, len(raw), _STEP):
            grams = _grams(raw[at : at + _STEP + size - 1], size)
            found = np.flatnonzero(passing(_hashed(grams), useful))
            place = found + at
            text = np.searchsorted(begins, place, "right") - 1
            inside = place + size <= begins[text + 1]
            yield text[inside], place[inside], grams[found[inside]], size


def _needles(keywords: DataFrame) -> DataFrame:
    """Rows (needle, length, blocks, block, begin, bytes, grams): the distinct keywords in lower case, cut into blocks, with
    the grams of each block in order."""

    def run(batches):
        for batch in batches:
            out = []
            for needle in batch.column("needle").to_pylist():
                begins = [*range(0, len(needle) - BLOCK, BLOCK), max(len(needle) - BLOCK, 0)]
                for i, begin in enumerate(begins):
                    own = needle[begin : begin + BLOCK]
                    grams = _grams(np.frombuffer(own, np.uint8), min(GRAM, len(own)))
                    out.append((needle, len(begins), i, begin, own, grams.tolist(), _hashed(grams).view(np.int64).tolist()))
            types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = list(zip(*out)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["needle", "blocks", "block", "begin", "bytes", "grams", "hashes"])

    needles = keywords.select(F.lower("keyword").cast("binary").alias("needle")).distinct()
    return needles.mapInArrow(
        run, "needle binary, blocks int, block int, begin long, bytes binary, grams array<long>, hashes array<long>")


def _counts(texts: DataFrame, wanted: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Rows (gram, times): in how many places the texts hold grams, at least for those `wanted`."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, "hash"))

    def run(batches):
        useful = np.frombuffer(bits.value, np.uint8)
        for _, data, begins in _texts(batches):
            found = [grams for _, _, grams, _ in _places(data, begins, sizes, useful)]
            values, times = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(times, pa.int64())], ["gram", "times"])

    return texts.select("__text").mapInArrow(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))


def _anchored(needles: DataFrame, texts: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The blocks that can be found at all, each with its rarest gram and the gram's place in it."""
    each = needles.select("needle", "block", F.posexplode(F.arrays_zip("grams", "hashes")).alias("offset", "own"))
    each = each.select("needle", "block", "offset", F.col("own.grams").alias("gram"), F.col("own.hashes").alias("hash"))
    counts = _counts(texts, each.select("hash").distinct(), sizes)
    rarest = each.join(counts, "gram").groupBy("needle", "block").agg(F.min(F.struct("times", "gram", "offset", "hash")).alias("own"))
    return needles.drop("grams", "hashes").join(rarest, ["needle", "block"]).select(
        "needle", "blocks", "block", "begin", "bytes", "own.gram", "own.offset", "own.hash")


def _hits(texts: DataFrame, anchors: DataFrame, sizes: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """Rows (keep, __row, gram, place, before, around): every place of a chosen gram, with the bytes around it, of which `before`
    come before it. `__row` is unique for a text."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(anchors, "hash"))

    def run(batches):
        useful, row = np.frombuffer(bits.value, np.uint8), TaskContext.get().partitionId() << 33
        for part, data, begins in _texts(batches):
            for text, place, grams, size in _places(data, begins, sizes, useful):
                low = np.maximum(begins[text], place - BLOCK + size) if size == GRAM else place
                high = np.minimum(begins[text + 1], place + BLOCK) if size == GRAM else place + size
                kept = part.select(list(keep)).take(pa.array(text))
                around = pa.array([data[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(row + text, pa.int64()), pa.array(grams, pa.int64()),
                     pa.array(place - begins[text], pa.int64()), pa.array(place - low, pa.int32()), around],
                    [*keep, "__row", "gram", "place", "before", "around"])
            row += part.num_rows

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in keep)
    return texts.mapInArrow(run, f"{kinds}, __row long, gram long, place long, before int, around binary")


def table_hits(rows: DataFrame, text: Column, keywords: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row (keep, keyword_group, keyword, weight) per text and row of `keywords` (keyword_group, keyword, weight) that it contains,
    however often it does. `keep` names columns of `rows`.

    Null texts contain nothing; null and empty keywords are nowhere; keywords that differ in case only, or that several groups
    have, are found by themselves; rows that repeat in either table count once in `keywords`, and each in `rows`.
    """
    words = keywords.select("keyword_group", "keyword", "weight").where("keyword <> ''").distinct()
    needles = stored(_needles(words), "needles")
    texts = rows.select(*keep, F.coalesce(F.lower(text), F.lit("")).cast("binary").alias("__text"))
    sizes = sorted(r[0] for r in needles.select(F.least(F.length("bytes"), F.lit(GRAM)).alias("size")).distinct().collect())
    anchors = stored(_anchored(needles, texts, sizes), "anchors")
    hits = stored(_hits(texts, anchors, sizes, keep), "hits")
    begin = F.col("before") - F.col("offset")
    same = (begin >= 0) & (F.substring("around", F.greatest(begin, F.lit(0)) + 1, F.length("bytes")) == F.col("bytes"))
    start = F.col("place") - F.col("offset") - F.col("begin")
    found = hits.join(anchors.drop("hash"), "gram").where(same).select(*keep, "__row", "needle", "blocks", "block", start.alias("start"))
    whole = found.where("blocks = 1").select(*keep, "__row", "needle")
    long = (
        found.where("blocks > 1").groupBy("__row", "needle", "start", *keep)
        .agg(F.count_distinct("block").alias("n"), F.first("blocks").alias("blocks")).where("n = blocks").select(*keep, "__row", "needle"))
    once = whole.unionByName(long).distinct()
    named = words.withColumn("needle", F.lower("keyword").cast("binary"))
    return once.join(named, "needle").select(*keep, "keyword_group", "keyword", "weight")


def table_points(hits: DataFrame, by: Sequence[str], cap: float) -> DataFrame:
    """Points (by, points) of the texts with hits: the sum of the weights, added exactly, up to the cap."""
    total = F.sum(F.col("weight").cast("decimal(28,8)")).cast("double")
    return hits.groupBy(*by).agg(F.least(total, F.lit(float(cap))).alias("points"))
