"""All sources of a registry, scanned and put together."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedrank.session import stored
from feedrank.sources.feeds import scan_feeds, unreadable_feeds
from feedrank.sources.landing import (
    failed_feeds,
    failed_payloads,
    failed_sources,
    settled,
    union_items,
    unsupported_sources,
    unsupported_warnings,
)
from feedrank.sources.registry import source_parts
from feedrank.sources.stories import read_stories, unreadable_payloads
from feedrank.sources.trending import scan_trending


class Collected(NamedTuple):
    items: DataFrame
    warnings: DataFrame


def _listed(sources: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The parts of the selected sources, and the sources that cannot be scanned at all."""
    sources = stored(sources, "sources")  # a short list that every scan joins
    unsupported = unsupported_sources(sources)
    scanned = sources.filter(~F.col("source_config_id").isin(list(unsupported)))
    return source_parts(scanned), unsupported


def _without(rows: DataFrame, failed: DataFrame) -> DataFrame:
    return rows.join(failed.select("run_date", "source_config_id"), ["run_date", "source_config_id"], "left_anti")


def _failed(landed: DataFrame, stories: DataFrame | None, parts: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Sources that failed; the landed fetches without those whose fetches failed; and the items of the stories.

    What failed is a stored table, so Spark broadcasts it if it is small and bodies are not shuffled. Payloads are parsed
    once, for what failed and for the items.
    """
    failed = stored(failed_sources(landed, parts), "failed")
    usable = _without(landed, failed)
    if stories is None:
        return failed, usable, None
    read = stored(read_stories(usable, stories, parts), "stories")
    unread = failed_payloads(unreadable_payloads(read))
    return failed.unionByName(unread), usable, _without(read.filter("NOT unreadable"), unread)


def _items(landed: DataFrame, usable: DataFrame, told: DataFrame, parts: DataFrame) -> DataFrame:
    return union_items([scan_feeds(landed, parts), scan_trending(usable, parts), told])


def _warnings(
    landed: DataFrame, parts: DataFrame, failed: DataFrame, unsupported: dict[str, str]
) -> DataFrame:
    feeds = failed_feeds(landed, parts, scan_feeds, unreadable_feeds)
    return reduce(
        DataFrame.unionByName, [failed, feeds, unsupported_warnings(landed, unsupported)]
    )


def collect_items(landed: DataFrame, stories: DataFrame, sources: DataFrame) -> DataFrame:
    """Raw items of the selected sources, in registry order; failed sources give none."""
    parts, _ = _listed(sources)
    landed = settled(landed)
    _, usable, told = _failed(landed, stories, parts)
    return _items(landed, usable, told, parts)


def fetch_warnings(landed: DataFrame, sources: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    """One warning per run date and failed source; with `stories`, of unreadable payloads as well."""
    parts, unsupported = _listed(sources)
    landed = settled(landed)
    failed, _, _ = _failed(landed, stories, parts)
    return _warnings(landed, parts, failed, unsupported)


def collect(landed: DataFrame, stories: DataFrame, sources: DataFrame) -> Collected:
    """Items and warnings.

    `landed` and `stories` may hold many run dates; each is treated on its own.
    """
    parts, unsupported = _listed(sources)
    landed = settled(landed)
    failed, usable, told = _failed(landed, stories, parts)
    return Collected(
        _items(landed, usable, told, parts), _warnings(landed, parts, failed, unsupported)
    )
