"""What the operators of this subpackage share: words, and rows of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedrank.session import configure, release, shared_folder, stored, stored_since

__all__ = ["GAP", "WORD", "ready", "release", "rows_of", "shared_folder", "stored", "stored_since", "unused", "words"]

#: A word is a run of other characters than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on."""
    return configure(spark)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as Python tuples, some hundreds at a time, so that a batch of long texts
    is not held twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield list(zip(*(column.to_pylist() for column in part.columns)))
