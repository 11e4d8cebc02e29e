"""Repeated runs of lines, found by winnowing over line hashes and deleted where they come again.

Lines are cut at line feeds; lines without a word are blank, and runs pass over them. A line is deleted if it lies in a run of
`words` words or more whose lines all come, one after the other, at an earlier place too, in the order of (doc_id, hash of the
text, line).

Windows are the shortest runs of `words` words from a line on, and those up to a line. The first place of a window's least line
hash is selected; windows that overlap mostly select the same place, so a document has few. Any run of `words` words or more that two
documents share holds a whole window with the same lines, which selects the same line of it in both: no such run is missed.
Selected places are joined by the hash of their line, and only where it is selected elsewhere too are they
extended, backwards and forwards, to the windows that selected them; windows with equal lines, by the hash of all of them, are
one class, of which all but the first are deleted. A longer match is the union of its windows: those from each of its lines on cover
it up to its last `words` words, and those up to each of its lines the rest, whatever the first places of each are. So nothing
has to be compared in pairs, and a place that a third of all documents hold is counted before it is shuffled.

Everything is DataFrame expressions. Lines travel as hashes; texts move once, to be joined with what is
to be deleted. Every deleted line is still there in an earlier place.

Defined results: null texts stay null, and empty ones empty; rows that repeat doc_id and text count
as one document, and all lose the same lines; documents with a null doc_id come first in the order; a
document may lose all its lines and is then empty; of equal hashes in a window the first place is selected; the lines of a very long
text are rows like others; an empty table gives no rows; all columns of the input, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedrank.llm.common import WORD, stored, unused

WORDS = 50


def _documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (d, t, units): the document's key, and of each line with words its hash and number of words."""
    text = docs[text_column]
    units = F.filter(
        F.transform(F.split(text, "\n"), lambda line: F.struct(
            F.xxhash64(line).alias("h"), F.regexp_count(line, F.lit(WORD)).alias("n"))),
        lambda unit: unit["n"] > 0)
    rows = docs.where(text.isNotNull()).select(
        docs[id_column].alias("d"), F.xxhash64(text).alias("t"), units.alias("units"))
    return rows.groupBy("d", "t").agg(F.first("units").alias("units"))


def _selected(documents: DataFrame, words: int) -> DataFrame:
    """A row per selected place: its document (d, t), the hash `h` of its line, and the windows that selected it, with the place
    `a` of their first line among the units, their number of units `c` and the hash `content` of all their lines."""
    document = Window.partitionBy("d", "t")
    units = documents.select("d", "t", F.posexplode("units").alias("u", "unit")).select("d", "t", "u", "unit.h", "unit.n")
    ended = units.withColumn("end", F.sum("n").over(document.orderBy("u"))).withColumn("start", F.col("end") - F.col("n"))
    onward, back = document.orderBy("start").rangeBetween(0, words - 1), document.orderBy("end").rangeBetween(1 - words, 0)

    def window(run) -> Column:
        """Null where there are less than `words` words."""
        first = F.min("u").over(run)
        return F.when(F.sum("n").over(run) >= words, F.struct(
            F.min(F.struct("h", "u")).over(run).alias("least"), first.alias("a"),
            (F.max("u").over(run) - first + 1).alias("c"), F.xxhash64(F.collect_list("h").over(run)).alias("content")))

    both = ended.select("d", "t", window(onward).alias("on"), window(back).alias("up"))
    windows = both.select("d", "t", F.explode(F.array_distinct(F.array_compact(F.array("on", "up")))).alias("w"))
    return windows.groupBy("d", "t", "w.least").agg(
        F.collect_set(F.struct("w.a", "w.c", "w.content")).alias("windows")).select("d", "t", "least.h", "windows")


def repeated_runs(docs: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (d, t, runs): for each document, by its id and the hash of its text, the first and last places, among its
    lines with words, of what is to be deleted."""
    selected = stored(_selected(_documents(docs, id_column, text_column), words), "selected")
    again = selected.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h")
    extended = selected.join(again, "h").select("d", "t", F.explode("windows").alias("w")).select("d", "t", "w.*")
    place = F.struct("d", "t", "a")
    firsts = extended.groupBy("content").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).where("times > 1")
    later = extended.join(firsts.select("content", "first"), "content").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("d", "t").agg(
        F.collect_set(F.struct("a", (F.col("a") + F.col("c") - 1).cast("int").alias("b"))).alias("runs"))


def without_repeats(docs: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with the later occurrences of repeated runs deleted from the texts."""
    d, t, runs, units = unused(docs, "d", "t", "runs", "units")
    found = repeated_runs(docs, words, id_column, text_column)
    gone = found.select(F.col("d").alias(d), F.col("t").alias(t), F.col("runs").alias(runs))
    text = docs[text_column]
    joined = docs.join(gone, docs[id_column].eqNullSafe(gone[d]) & (F.xxhash64(text) == gone[t]), "left")
    lines = F.split(text, "\n")
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    with_words = F.filter(numbers, lambda i: F.get(lines, i).rlike(WORD))
    places = joined.select(*(docs[c] for c in docs.columns), runs, F.when(F.col(runs).isNotNull(), with_words).alias(units))
    deleted = F.flatten(F.transform(runs, lambda run: F.sequence(F.get(units, run["a"]), F.get(units, run["b"]))))
    left = F.transform(F.array_except(numbers, deleted), lambda i: F.get(lines, i))
    cut = F.when(F.col(runs).isNull(), text).otherwise(F.array_join(left, "\n"))
    return places.select(*((cut if c == text_column else F.col(f"`{c}`")).alias(c) for c in docs.columns))
