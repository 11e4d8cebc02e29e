"""Session settings, and tables stored to cut lineage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Bodies come in more charsets than Spark's own few, and with bytes that theirs do not have.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    # Long texts must not add up to huge batches on their way to Python.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def _stored() -> list[str]:
    """The tables stored by this thread: jobs that run side by side don't delete each other's. Kept with the thread, since
    what functions refer to in this package is sent to executors with them."""
    return threading.current_thread().__dict__.setdefault("feedrank_stored", [])


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan here relies on; all times are UTC."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def stored(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again: a lineage cut that survives
    lost executors, is pruned when read, and whose real size the planner knows. Files stay until
    `release`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    _stored().append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_since(mark: int) -> list[str]:
    """The stored tables that this thread made after `mark`, which is the length of an earlier list from 0."""
    return _stored()[mark:]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, wherever it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete stored tables: those given, or all of this thread so far. Only for tables that nothing
    will read again."""
    for path in list(_stored()) if paths is None else paths:
        delete(spark, path.rsplit("/", 1)[0])
        if path in _stored():
            _stored().remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what this thread stored inside. Results must have been written by then."""
    mark = len(stored_since(0))
    try:
        yield
    finally:
        release(spark, stored_since(mark))
