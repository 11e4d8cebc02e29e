"""The daily run over an archive of dates: enrich, de-duplicate, select, rank, report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedrank.functions.times import as_timestamp, parse_iso, run_date
from feedrank.operators.dedup import only_survivors, survivors
from feedrank.operators.enrich import enrich, with_identity
from feedrank.operators.rank import select_candidates, top_n
from feedrank.operators.stats import run_stats
from feedrank.params import Params
from feedrank.session import configure, stored
from feedrank.sinks.raw import run_header, write_raw
from feedrank.sinks.report import report_documents
from feedrank.sources.collect import collect
from feedrank.sources.registry import (
    check_registry,
    default_registry,
    parse_source_ids,
    read_registry,
    select_sources,
)


EARLIEST = "0001-01-01T00:00:00Z"  # no parsed time is before it


class DailyRun(NamedTuple):
    deduped: DataFrame
    candidates: DataFrame
    top: DataFrame
    stats: DataFrame
    reports: DataFrame


def for_dates(rows: DataFrame, dates: Iterable[dt.date | str] | None) -> DataFrame:
    """The rows of the given run dates; all if there is none given. To be applied to the rows as they are
    read, since a filter does not pass a computed column on its way to the scan."""
    if dates is None:
        return rows
    wanted = [F.lit(str(date)).cast("date") for date in dates]
    return rows.filter(F.col("run_date").isin(*wanted)) if wanted else rows.limit(0)


def deduplicated(
    items: DataFrame, now: Column, params: Params = Params(), scope: Sequence[str] = ("run_date",)
) -> DataFrame:
    """Enriched items, each date's duplicates removed.

    Which items survive depends on title, URL and source id only, so that is worked out on
    those columns, and summaries are cleaned and scored for the survivors alone. A malformed
    time still aborts the job, even on an item that is dropped later.
    """
    timed = items.filter(parse_iso(F.col("published_at"), now) >= F.lit(EARLIEST).cast("timestamp"))
    kept = survivors(with_identity(timed, params), scope)
    return enrich(only_survivors(items, kept), now, params)


def daily_top(
    items: DataFrame, now: Column, params: Params = Params(), dates: Iterable[dt.date | str] | None = None
) -> DataFrame:
    """The best items of each run date, or of the given ones, numbered in `rank`."""
    kept = deduplicated(for_dates(items, dates), now, params)
    return top_n(select_candidates(kept, params.threshold), params.top_n, now)


def daily_run(
    items: DataFrame, now: Column, params: Params = Params(), dates: DataFrame | None = None
) -> DailyRun:
    """All results of a run over the raw items of one or many dates.

    The kept items are stored once, since every other result is derived from them.
    """
    deduped = stored(deduplicated(items, now, params), "deduped")
    candidates = select_candidates(deduped, params.threshold)
    top = top_n(candidates, params.top_n, now)
    stats = run_stats(items, deduped, params.threshold, params.top_n, now, dates)
    return DailyRun(deduped, candidates, top, stats, report_documents(top, stats, params))


def run_job(
    spark: SparkSession,
    registry_path: str | None,
    landed: DataFrame,
    stories: DataFrame,
    output: str,
    now: str,
    sources: str = "",
    params: Params = Params(),
    dates: Iterable[dt.date | str] | None = None,
    relative: str | None = None,
) -> DataFrame:
    """Landed fetches to raw JSON and reports, published together under `output`; returns the warnings.

    Without a registry path the default sources are used; `sources` selects by id or alias. `dates` are
    the run dates, or `relative` names one as of `now` (today, yesterday, day-before); without either,
    all that has landed is run.
    """
    configure(spark)
    if relative is not None:
        as_of = dt.datetime.fromisoformat(now.replace("Z", "+00:00")).astimezone(dt.timezone.utc).date()
        dates = [*(dates or ()), run_date(relative, as_of=as_of)]
    landed, stories = for_dates(landed, dates), for_dates(stories, dates)
    registry = read_registry(spark, registry_path) if registry_path else default_registry(spark)
    check_registry(registry)
    chosen = select_sources(registry, parse_source_ids(sources))
    collected = collect(landed, stories, chosen)
    items = stored(collected.items, "items")  # parsed once; far smaller than the landed bodies
    run = daily_run(items, as_timestamp(now), params, landed.select("run_date"))
    ids = [r[0] for r in chosen.orderBy("source_pos").select("source_config_id").collect()]
    write_raw(run.deduped, run_header(run.stats, registry_path, ids), output, run.reports)
    return collected.warnings
