"""Counts per run date and per source."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.functions.times import iso_utc


def run_stats(
    raw: DataFrame,
    deduped: DataFrame,
    threshold: float,
    top_n: int,
    generated_at: Column,
    dates: DataFrame | None = None,
) -> DataFrame:
    """One row per run date: items fetched (before any is dropped), kept by de-duplication,
    at or above the threshold, and listed. `dates` adds run dates that fetched nothing."""
    fetched = raw.groupBy("run_date").agg(F.count("*").alias("total_fetched"))
    if dates is not None:
        fetched = dates.select("run_date").distinct().join(fetched, "run_date", "left")
    reached = F.coalesce("score", F.lit(0.0)) >= F.lit(float(threshold))
    kept = deduped.groupBy("run_date").agg(
        F.count("*").alias("after_dedup"), F.count_if(reached).alias("above_threshold")
    )
    return (
        fetched.join(kept, "run_date", "left")
        .fillna(0, ["total_fetched", "after_dedup", "above_threshold"])
        .withColumn("top_n", F.least(F.lit(max(top_n, 0)).cast("bigint"), "above_threshold"))
        .withColumn("threshold", F.lit(float(threshold)))
        .withColumn("generated_at", iso_utc(generated_at))
    )


def utc_now() -> Column:
    """The moment of the call, as a constant."""
    return F.lit(dt.datetime.now(dt.timezone.utc).isoformat()).cast("timestamp")


def source_counts(raw: DataFrame) -> DataFrame:
    """Items fetched per run date and configured source."""
    return raw.groupBy("run_date", "source_config_id").agg(F.count("*").alias("fetched"))
