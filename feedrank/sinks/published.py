"""Outputs of a run that appear together, date by date, or not at all.

A publication writes every output under a folder of its own version, by run date, and at last one small file, the
manifest, that names its dates. Readers take each date from the latest publication that names it. So a run that
breaks off before the manifest leaves every date as it was, and a date never shows items of one run with
statistics or a report of another. A date that is published again without items has none.

    <path>/<output>/version=<v>/run_date=<d>/...      <path>/manifest/version=<v>/...
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedrank.session import delete

MANIFEST = "manifest"


def _micros() -> int:
    return time.time_ns() // 1000


def publish(outputs: Mapping[str, DataFrame], dates: DataFrame, path: str) -> str:
    """Write `outputs` (JSON lines; text files where `value` is the only column besides `run_date`) and then their manifest
    for all `dates`; returns the version. Only what belongs to these dates should be in the outputs."""
    path, version = path.rstrip("/"), f"{_micros():016d}-{uuid.uuid4().hex[:12]}"
    for name, rows in outputs.items():
        # Rebalancing splits the rows of a large date over several files and tasks.
        writer = rows.hint("rebalance", "run_date").write.partitionBy("run_date").option("ignoreNullFields", "false")
        target = f"{path}/{name}/version={version}"
        writer.text(target) if set(rows.columns) == {"run_date", "value"} else writer.json(target)
    named = dates.select("run_date").distinct().withColumn("published", F.lit(_micros()))
    # One file, so that all its dates appear at once.
    named.coalesce(1).write.json(f"{path}/{MANIFEST}/version={version}")
    return version


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run_date DATE, published BIGINT, version STRING").json(f"{path.rstrip('/')}/{MANIFEST}")


def _latest() -> Column:
    return F.max_by("version", F.struct("published", "version")).alias("version")


def current(spark: SparkSession, path: str) -> DataFrame:
    """(run_date, version): where each published date is to be read."""
    return _manifests(spark, path).groupBy("run_date").agg(_latest())


def read_published(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    """An output of all published dates. Folders of other versions are pruned, not read."""
    rows = spark.read.schema(_with_version(schema))
    found = f"{path.rstrip('/')}/{name}"
    text = set(schema.names) == {"run_date", "value"}
    read = rows.text(found, wholetext=True) if text else rows.json(found)
    return read.join(current(spark, path), ["run_date", "version"], "left_semi").select(*schema.names)


def _with_version(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("version", StringType())])


def clean(spark: SparkSession, path: str, outputs: list[str]) -> list[str]:
    """Delete publications none of whose dates is read any more; returns their versions. Not while readers
    that began before their successors are still at work."""
    path = path.rstrip("/")
    published = _manifests(spark, path).select("version").distinct()
    gone = [r[0] for r in published.join(current(spark, path), "version", "left_anti").collect()]
    for version in gone:
        for name in (*outputs, MANIFEST):
            delete(spark, f"{path}/{name}/version={version}")
    return gone
