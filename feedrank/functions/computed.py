"""Columns that are evaluated once per row, however often they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with the columns added or replaced.

    The optimizer copies the definition of a plain column into every filter it pushes down
    and into expressions that use it, which for long text repeats costly work many times. It
    never copies a value that hangs on a nondeterministic condition; this one is always true.
    """
    always = F.monotonically_increasing_id() >= 0
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, *(F.when(always, v).alias(name) for name, v in columns.items()))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), use), 0)
