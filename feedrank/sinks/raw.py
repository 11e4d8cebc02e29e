"""The raw JSON output of each run date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedrank.sinks.published import publish, read_published
from feedrank.sinks.report import report_files


def run_header(stats: DataFrame, config_path: str | None, source_ids: Sequence[str]) -> DataFrame:
    """One row per run date: its statistics and what the run was configured with."""
    counts = ["total_fetched", "after_dedup", "above_threshold", "top_n", "threshold", "generated_at"]
    sources = [F.lit(s) for s in source_ids]
    return stats.select(
        "run_date",
        F.struct(*counts).alias("stats"),
        F.struct(
            F.lit(config_path).cast("string").alias("config_path"),
            F.array(*sources).cast("array<string>").alias("selected_sources"),
            F.lit(len(source_ids)).alias("source_count"),
        ).alias("run_meta"),
    )


OUTPUTS = ["items", "runs", "reports"]


def read_raw(spark: SparkSession, path: str, items: StructType, header: StructType) -> DataFrame:
    """What `write_raw` has published: every item with the statistics of its run date."""
    lines = read_published(spark, path, "items", items)
    runs = read_published(spark, path, "runs", header).select("run_date", "stats.*")
    return lines.join(runs, "run_date")


def write_raw(deduped: DataFrame, header: DataFrame, path: str, reports: DataFrame | None = None) -> str:
    """Publish kept items (whatever their score) as `items`, one line each, the run headers as `runs`, and the
    Markdown of `reports`, all for the dates of the headers; returns the version. Dates that were published
    before are replaced as a whole, others stay."""
    outputs = {"items": deduped, "runs": header}
    if reports is not None:
        outputs["reports"] = report_files(reports)
    return publish(outputs, header, path)
