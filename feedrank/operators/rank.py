"""Selection and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedrank.functions.times import parse_iso


def select_candidates(items: DataFrame, threshold: float) -> DataFrame:
    """Items that reach the threshold. Apply after de-duplication only: a low-scoring first
    copy still removes its later, better-scoring copies."""
    return items.filter(F.coalesce("score", F.lit(0.0)) >= F.lit(float(threshold)))


def ranking(now: Column) -> list[Column]:
    """Best score first, then the older item, then input order."""
    return [
        F.coalesce("score", F.lit(0.0)).desc(),
        parse_iso(F.col("published_at"), now).asc(),
        F.col("ord").asc(),
    ]


def first_of_each(
    rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank", parts: int = 1
) -> DataFrame:
    """The first `n` rows of each group in the given order, numbered from 1 in `rank`.

    A task passes on no more than its own first `n` of each group, so what is shuffled is bounded by
    tasks, groups and `n`, however large a group is. With `parts`, groups are first cut in so many
    parts by a hash of the order, so that one task ends up with `parts` times `n` rows of a group at most,
    whatever the number of tasks. Ties should be broken by `order`.
    """
    rows.sparkSession.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(2**31 - 1))
    n = max(n, 0)
    groups = [Window.partitionBy(*by).orderBy(*order)]
    if parts > 1:
        dealt = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
        groups.insert(0, Window.partitionBy(*by, dealt).orderBy(*order))
    for group in groups:
        rows = rows.withColumn(rank, F.row_number().over(group)).filter(F.col(rank) <= n)
    return rows


def top_n(
    items: DataFrame, n: int, now: Column, by: Sequence[str] = ("run_date",)
) -> DataFrame:
    """The `n` best items of each group, numbered from 1 in `rank`; of all items if `by` is empty."""
    order = ranking(now)
    if not by:
        best = items.orderBy(*order).limit(max(n, 0))
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return first_of_each(items, by, order, n)
