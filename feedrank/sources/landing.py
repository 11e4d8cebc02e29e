"""Landed fetches: positions, failures and the union of all scans."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.schemas import ITEM_COLUMNS, POPULARITY
from feedrank.session import stored
from feedrank.sources.registry import PART_PARAMS, STORY_FEEDS

# Bits of `ord` for the positions of a source, of a part in it, and of a row in that.
SOURCE_BITS, PART_BITS, ROW_BITS = 17, 16, 28


def position(source_pos: Column, part_pos: Column, row_pos: Column) -> Column:
    """Source, part and row position as one sortable number."""
    too_large = (
        (source_pos >= 2**SOURCE_BITS) | (part_pos >= 2**PART_BITS) | (row_pos >= 2**ROW_BITS)
    )
    number = (
        F.shiftleft(source_pos.cast("bigint"), PART_BITS + ROW_BITS)
        + F.shiftleft(part_pos.cast("bigint"), ROW_BITS)
        + row_pos
    )
    return F.when(too_large, F.raise_error(F.lit("position out of range")).cast("bigint")).otherwise(
        number
    )


def popularity(**fields: Column) -> Column:
    """The popularity struct with the given fields, the others null."""
    names = ("stars_total", "stars_today", "language", "hn_score", "hn_comments")
    return F.struct(
        *(fields.get(n, F.lit(None)).alias(n) for n in names)
    ).cast(POPULARITY)


def landed_parts(landed: DataFrame, parts: DataFrame, source_type: str) -> DataFrame:
    """Landed fetches of one source type, with their positions and parameters. Parts go to the bodies: dealt by part, bodies
    would come to as many tasks as there are parts."""
    chosen = parts.filter(F.col("source_type") == source_type)
    return landed.join(F.broadcast(chosen), ["source_config_id", "part"])


def settled(landed: DataFrame) -> DataFrame:
    """One attempt for each part of a source on a date: of several, the first that succeeded, those on the run date
    before others, or the last that failed. Bodies travel only for parts that were tried more than once, and only once."""
    by = ["run_date", "source_config_id", "part"]
    repeated = stored(landed.groupBy(*by).count().where("count > 1").select(*by), "repeated")
    if repeated.isEmpty():
        return landed
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    named = repeated.select(*(F.col(c).alias(f"__{c}") for c in by))
    others = [c for c in landed.columns if c not in by]
    moment = F.unix_micros("fetched_at")
    state = (
        F.when(F.coalesce("status", F.lit("")) != "ok", 2)
        .when(F.coalesce(F.to_date("fetched_at") == F.col("run_date"), F.lit(False)), 0).otherwise(1))
    # Attempts at the same moment are told apart by what they say, so that the choice does not depend on their order.
    order = F.struct(
        state.alias("state"), F.when(state == 2, -moment).otherwise(moment).alias("moment"),
        F.coalesce("error", F.lit("")).alias("error"), F.xxhash64("body").alias("hash"))
    tried = landed.join(named, same, "left_semi").groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("own"))
    chosen = landed.join(named, same, "left_anti").unionByName(tried.select(*by, "own.*").select(*landed.columns))
    return stored(chosen, "settled")  # every scan reads it


def _reason() -> Column:
    """Why an attempt makes its source fail, null if it does not (or not on its own)."""
    kind, error = F.col("source_type"), F.coalesce("error", F.when(F.col("status").isNull(), "no status"), F.lit(""))
    failed = F.coalesce("status", F.lit("")) != "ok"  # an attempt without a status failed
    due = (kind != "github_trending") | (F.to_date("fetched_at") == F.col("run_date"))
    return F.when(failed & (kind == "rss"), F.concat("part", F.lit(": "), error)).when(
        failed & due, error
    )


NO_FEED, NO_LIST = "body is no feed", "body is no list"


def _unreadable_lists(landed: DataFrame, parts: DataFrame) -> DataFrame:
    """Fetched story lists that are no JSON array."""
    lists = landed_parts(landed, parts, "hackernews").filter(F.col("status") == "ok")
    kind = F.schema_of_variant(F.try_parse_json("body"))
    return lists.filter(~F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False)))


def _failed_attempts(landed: DataFrame, parts: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Attempts that failed, and those of `unreadable` (with `error`), whose body says nothing."""
    shown = ["run_date", "source_config_id", "source_type", "part_pos"]
    tried = landed.drop("body").join(F.broadcast(parts), ["source_config_id", "part"])
    failed = tried.select(*shown, _reason().alias("reason")).filter(F.col("reason").isNotNull())
    if unreadable is None:
        return failed
    bad = unreadable.withColumn("status", F.lit("failed")).select(*shown, _reason().alias("reason"))
    return failed.unionByName(bad)


def _warning(reason: Column) -> Column:
    return F.concat("source_config_id", F.lit(" failed: "), reason).alias("message")


def failed_sources(landed: DataFrame, parts: DataFrame) -> DataFrame:
    """Trending and story sources that failed on a date: one failed language or list loses the whole source. Trending
    pages count only on their own date."""
    bad = _unreadable_lists(landed, parts).withColumn("error", F.lit(NO_LIST))
    by_part = ["run_date", "source_config_id", "part_pos", "reason"]
    attempts = _failed_attempts(landed, parts, bad).filter(F.col("source_type") != "rss").select(by_part)
    return (
        attempts.groupBy("run_date", "source_config_id")
        .agg(F.min_by("reason", "part_pos").alias("reason"))
        .select("run_date", "source_config_id", _warning(F.col("reason")))
    )


def failed_payloads(payloads: DataFrame) -> DataFrame:
    """Story sources that failed on a date for a payload that cannot be read: (run_date, source_config_id, reason)."""
    return payloads.select("run_date", "source_config_id", _warning(F.col("reason")))


def failed_feeds(
    landed: DataFrame,
    parts: DataFrame,
    scan: Callable[[DataFrame, DataFrame], DataFrame],
    unreadable: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Feed sources that failed on a date: some URL failed or gave what is no feed, and the others gave
    no item.

    Only the feeds of such sources are scanned for this.
    """
    by = ["run_date", "source_config_id"]
    fetched = landed_parts(landed, parts, "rss").filter(F.col("status") == "ok")
    bad = unreadable(fetched).withColumn("error", F.lit(NO_FEED))
    suspects = (
        _failed_attempts(landed, parts, bad)
        .filter(F.col("source_type") == "rss")
        .groupBy(*by, "part_pos")
        .agg(F.min("reason").alias("reason"))
        .groupBy(*by)
        # one entry per configured URL of the source
        .agg(F.array_sort(F.collect_list(F.struct("part_pos", "reason"))).alias("reasons"))
    )
    fruitful = scan(landed.join(suspects, by, "left_semi"), parts).select(*by).distinct()
    return suspects.join(fruitful, by, "left_anti").select(
        *by, _warning(F.array_join(F.col("reasons.reason"), "; "))
    )


def unsupported_sources(sources: DataFrame) -> dict[str, str]:
    """Configured sources that fail on every date, and why: an unknown type or story list."""
    unknown = F.filter("parts", lambda p: ~p.isin(*STORY_FEEDS))
    reason = F.when(
        ~F.col("source_type").isin(*PART_PARAMS),
        F.concat(F.lit("unsupported source type: "), "source_type"),
    ).when(
        (F.col("source_type") == "hackernews") & (F.size(unknown) > 0),
        F.concat(F.lit("unsupported list: "), F.get(unknown, 0)),
    )
    found = sources.select("source_config_id", reason.alias("reason")).filter("reason IS NOT NULL")
    return {r["source_config_id"]: r["reason"] for r in found.collect()}


def unsupported_warnings(landed: DataFrame, unsupported: dict[str, str]) -> DataFrame:
    """A warning per run date for each of these sources."""
    listed = F.array(*(
        F.struct(F.lit(name).alias("source_config_id"), F.lit(reason).alias("reason"))
        for name, reason in unsupported.items()
    )).cast("ARRAY<STRUCT<source_config_id: STRING, reason: STRING>>")
    dates = landed.select("run_date").distinct()
    return dates.select("run_date", F.inline(listed)).select(
        "run_date", "source_config_id", _warning(F.col("reason"))
    )


def union_items(scans: list[DataFrame]) -> DataFrame:
    """All scanned items; their order is in `ord`."""
    return reduce(DataFrame.unionByName, (s.select(*ITEM_COLUMNS) for s in scans))
