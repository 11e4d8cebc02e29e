"""Keyword hits as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.functions.computed import computed
from feedrank.params import Params


def keyword_hits(rows: DataFrame, text: Column, params: Params) -> DataFrame:
    """One row per keyword found in `text`, with its group and weight.

    The keyword table is a parameter, so the containment join is an expression evaluated
    while scanning: no pair that does not match is ever produced.
    """
    candidates = [
        F.when(
            F.contains(F.col("_text"), F.lit(keyword.lower())),
            F.struct(
                F.lit(group).alias("keyword_group"),
                F.lit(keyword).alias("keyword"),
                F.lit(float(params.group_weights[group])).alias("weight"),
            ),
        )
        for group, keywords in params.keyword_groups.items()
        for keyword in keywords
    ]
    return (
        computed(rows, _text=F.lower(text))
        .withColumn("hit", F.explode(F.array_compact(F.array(*candidates))))
        .drop("_text")
        .select("*", "hit.*")
        .drop("hit")
    )
