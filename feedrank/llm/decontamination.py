"""Which words of documents stand in passages of a benchmark: a set join with prefix filtering.

Every item is cut into windows of `window` words, each one word after the last; an item with fewer words is one
window. A document holds a window only if it holds all of its shingles, so it is enough to look for a necessary
prefix: with the shingles of a window ordered by how rare they are in the documents, for exact containment
the rarest one. So shingles are counted in the documents first, and then the places of the rarest ones are joined
with the windows they stand for. The place of a shingle in its window bounds where the window would begin
and end; what fits into the document is compared word by word.

Documents are read twice. Both times a fixed 2 MB of bits tells which shingles can be of any use: it never loses
one, and what it lets pass in vain is left by the joins. Nothing else is broadcast but what Spark itself finds small
enough. Joins are by shingle and by row, and a shingle that very many documents hold is one that its windows
have none rarer for; its rows are narrow, and adaptive execution splits them.

Defined results: null and empty texts, and those without a word, have no words and no hits; empty items, items
without a word and items with a null text have no windows; an item with a null id marks words but is not listed;
items that repeat an id are one item with all their windows, repeated items count once; each row of the documents
gives one row, with the same id or not; very long texts are taken whole; of equally rare shingles the one with the least
hash stands for a window, which changes no result; empty tables give no rows or no hits; other columns are
neither read nor returned, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.llm.common import rows_of, stored
from feedrank.llm.hashed_words import Texts, bitmap, grouped, passing

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words are runs of digits, letters and all that is not ASCII.
IS_GAP = np.array([not (chr(b).isdigit() or "a" <= chr(b) <= "z" or b >= 128) for b in range(256)])


@dataclass(frozen=True)
class Decontamination:
    """`window`: words of a passage that count as a hit; `shingle`: words of the shingles that are looked for."""

    window: int = 10
    shingle: int = 3


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(df[id_column].alias("id"), F.coalesce(df[text_column], F.lit("")).cast("binary").alias("text"))


def _batch(names: list[str], columns: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def item_windows(items: DataFrame, settings: Decontamination, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Rows (item_id string, words, n, shingles): every window of every item, its words joined by spaces, and the hashes of its
    shingles in order."""
    size, shingle = settings.window, settings.shingle

    def run(batches):
        for rows in rows_of(batches):
            for group in grouped(rows, 1):
                texts, out = Texts([r[1] for r in group], LOWER, IS_GAP), []
                for i, (item, _) in enumerate(group):
                    first, last = int(texts.first[i]), int(texts.first[i + 1])
                    n = min(size, last - first)
                    if not n:
                        continue
                    words = texts.words(first, last)
                    own = Texts([b" ".join(words)], LOWER, IS_GAP).shingles(min(shingle, n))[1].view(np.int64).tolist()
                    per = n - min(shingle, n) + 1
                    out += [(item, b" ".join(words[k : k + n]).decode(), n, own[k : k + per]) for k in range(len(words) - n + 1)]
                columns = zip(*out) if out else [()] * 4
                yield _batch(["item_id", "words", "n", "shingles"], list(columns),
                             [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())])

    narrow = _texts(items, id_column, text_column).withColumn("id", F.col("id").cast("string"))
    return narrow.mapInArrow(run, "item_id string, words string, n int, shingles array<long>")


def _sizes(windows: DataFrame, settings: Decontamination) -> list[int]:
    """How many words the shingles in use have: fewer than usual only for short windows."""
    return [r[0] for r in windows.select(F.least("n", F.lit(settings.shingle)).alias("size")).distinct().collect()]


def _counts(docs: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """Rows (shingle, times): how often the documents (id, text) hold shingles, at least for those `wanted`."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "shingle"))

    def run(batches):
        useful = np.frombuffer(bits.value, np.uint8)
        for rows in rows_of(batches):
            found = []
            for group in grouped(rows, 0):
                texts = Texts([r[0] for r in group], LOWER, IS_GAP)
                for size in sizes:
                    hashes = texts.shingles(size)[1]
                    found.append(hashes[passing(hashes, useful)])
            values, times = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
            yield _batch(["shingle", "times"], [np.array(values, np.uint64).view(np.int64), times], [pa.int64(), pa.int64()])

    counted = docs.select("text").mapInArrow(run, "shingle long, times long")
    return counted.groupBy("shingle").agg(F.sum("times").alias("times"))


def _prefixes(windows: DataFrame, docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Rows (w, words, n, shingle, offset): the rarest shingle of each window, and its place there; none for a window that holds
    a shingle no document has."""
    each = windows.select("w", F.posexplode("shingles").alias("offset", "shingle"))
    counts = _counts(docs, each.select("shingle").distinct(), sizes)
    rated = each.join(counts, "shingle", "left").select(
        "w", F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "offset").alias("own"))
    rarest = rated.groupBy("w").agg(F.min("own").alias("own")).where("own.times > 0")
    return windows.select("w", "words", "n").join(rarest, "w").select("w", "words", "n", "own.shingle", "own.offset")


def _scanned(docs: DataFrame, prefixes: DataFrame, settings: Decontamination, sizes: list[int]) -> DataFrame:
    """Rows (row, id, n_words, hits) for all documents: where shingles that stand for windows occur, each with the words
    around it that a window could reach, of which `before` come before it. `row` is unique."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(prefixes, "shingle"))
    window, shingle = settings.window, settings.shingle
    hit = pa.struct([("place", pa.int64()), ("shingle", pa.int64()), ("before", pa.int32()), ("words", pa.string())])
    kind = dict(docs.dtypes)["id"]

    def run(batches):
        useful, row = np.frombuffer(bits.value, np.uint8), TaskContext.get().partitionId() << 33
        for rows in rows_of(batches):
            for group in grouped(rows, 1):
                texts, hits = Texts([r[1] for r in group], LOWER, IS_GAP), [[] for _ in group]
                for size in sizes:
                    places, hashes = texts.shingles(size)
                    chosen = passing(hashes, useful)
                    for place, own in zip(places[chosen].tolist(), hashes[chosen].view(np.int64).tolist()):
                        text = int(texts.text[place])
                        first, last = int(texts.first[text]), int(texts.first[text + 1])
                        low, high = place, place + size
                        if size == shingle:
                            low, high = max(first, place - window + size), min(last, place + window)
                        hits[text].append((place - first, own, place - low, b" ".join(texts.words(low, high)).decode()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + len(group)), pa.int64()), pa.array([r[0] for r in group]).cast(id_type),
                    pa.array(np.diff(texts.first), pa.int64()),
                    pa.array([[dict(zip(("place", "shingle", "before", "words"), h)) for h in own] for own in hits], pa.list_(hit)),
                ], ["row", "id", "n_words", "hits"])
                row += len(group)

    id_type = pa.string() if kind == "string" else pa.int64()
    return docs.mapInArrow(
        run, f"row long, id {'string' if kind == 'string' else 'long'}, n_words long, "
             "hits array<struct<place: long, shingle: long, before: int, words: string>>")


def occurrences(scanned: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows (row, start, n, w): every place in a document where a window stands, word by word."""
    hits = scanned.select("row", F.inline("hits")).withColumnRenamed("words", "around")
    begin = F.col("before") - F.col("offset")
    around = F.split("around", " ")
    fits = (begin >= 0) & (begin + F.col("n") <= F.size(around))
    same = F.array_join(F.slice(around, F.greatest(begin, F.lit(0)) + 1, F.col("n")), " ") == F.col("words")
    return hits.join(prefixes, "shingle").where(fits & same).select(
        "row", (F.col("place") - F.col("offset")).alias("start"), F.col("n").cast("long").alias("n"), "w")


def covered(spans: Column) -> Column:
    """How many words sorted spans (start, stop) cover."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("reached"))

    def step(done: Column, span: Column) -> Column:
        new = F.greatest(span["stop"] - F.greatest(span["start"], done["reached"]), F.lit(0).cast("long"))
        return F.struct((done["words"] + new).alias("words"), F.greatest(done["reached"], span["stop"]).alias("reached"))

    return F.aggregate(spans, start, step)["words"]


def contamination(docs: DataFrame, benchmark: DataFrame, settings: Decontamination = Decontamination(),
                  id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_hit, spans, items) for all documents: how many words they have and how many of these
    stand in a window, where the windows are (start, stop; in words), and the items, as sorted strings."""
    each = stored(item_windows(benchmark, settings, item_column, item_text), "each")
    distinct = each.groupBy("words", "n").agg(F.first("shingles").alias("shingles"))
    windows = stored(distinct.withColumn("w", F.monotonically_increasing_id()), "windows")
    texts, sizes = _texts(docs, id_column, text_column), _sizes(windows, settings)
    prefixes = stored(_prefixes(windows, texts, sizes), "prefixes")
    scanned = stored(_scanned(texts, prefixes, settings, sizes), "scanned")
    found = stored(occurrences(scanned, prefixes), "occurrences")
    span = F.struct("start", (F.col("start") + F.col("n")).alias("stop"))
    spans = found.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    owners = each.where("item_id IS NOT NULL").select("item_id", "words").join(windows.select("words", "w"), "words").select(
        "w", "item_id").distinct()
    items = found.select("row", "w").distinct().join(owners, "w").groupBy("row").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    return (
        scanned.select("row", "id", "n_words").join(spans, "row", "left").join(items, "row", "left")
        .select(F.col("id").alias("doc_id"), "n_words",
                F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
                F.coalesce("spans", F.array().cast("array<struct<start: long, stop: long>>")).alias("spans"),
                F.coalesce("items", none).alias("items")))
