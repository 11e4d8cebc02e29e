"""Story lists and story payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.functions.computed import computed
from feedrank.functions.scoring import any_keyword
from feedrank.functions.text import clean_text, first_non_empty
from feedrank.functions.times import iso_utc, on_date
from feedrank.sources.landing import landed_parts, popularity, position

DISCUSSION_URL = "https://news.ycombinator.com/item?id="  # fixed value


def merge_lists(lists: DataFrame, by: list[str], ids: str = "ids", limit: str = "max_per_feed") -> DataFrame:
    """Ids of several lists as one ordered distinct list per `by`: the first `limit` of each,
    list after list (`part_pos`). `ord` is where the id was first seen."""
    first = F.slice(F.col(ids), F.lit(1), F.greatest(F.col(limit), F.lit(1)))
    seen = lists.select(*by, "part_pos", F.posexplode(first).alias("row_pos", "id"))
    ord_ = position(F.lit(0), F.col("part_pos"), F.col("row_pos"))
    return seen.groupBy(*by, "id").agg(F.min(ord_).alias("ord"))


def _haystack(payload: Column) -> Column:
    """Lower-cased title, text and URL; a field that is present but null reads "None"."""

    def shown(name: str) -> Column:
        absent = F.when(F.map_contains_key(payload, name), F.lit("None")).otherwise(F.lit(""))
        return F.coalesce(F.try_element_at(payload, F.lit(name)), absent)

    return F.lower(F.concat_ws(" ", shown("title"), shown("text"), shown("url")))


def story_items(stories: DataFrame, kept: Column | None = None) -> DataFrame:
    """Item fields of payloads in `body` that are stories, timed, titled and relevant, or for which `kept` holds.

    Needs `id`, `keywords` and `require_keyword_match` next to the payload.
    """
    kept = F.lit(False) if kept is None else kept
    payload = F.from_json("body", "map<string,string>")

    def number(name: str) -> Column:
        # A JSON number with a fraction or an exponent counts as its whole part.
        return F.try_element_at(F.col("payload"), F.lit(name)).try_cast("decimal(38,6)").try_cast("bigint")

    def text(name: str) -> Column:
        return F.try_element_at(F.col("payload"), F.lit(name))

    relevant = ~F.col("require_keyword_match") | any_keyword(F.col("haystack"), F.col("keywords"))
    others = [c for c in stories.columns if c not in ("body", "keywords", "require_keyword_match")]
    timed = computed(stories, payload=payload).filter(
        kept | (text("type") == "story") & (F.coalesce(number("time"), F.lit(0)) != 0)
    )
    asked = computed(timed, haystack=_haystack(F.col("payload"))).filter(kept | relevant)
    titled = computed(asked, title=clean_text(text("title"), 300)).filter(kept | (F.col("title") != ""))
    return titled.select(
        *others,
        F.lit("hn").alias("source"),
        F.lit("news.ycombinator.com").alias("source_name"),
        F.col("id").cast("string").alias("source_id"),
        "title",
        first_non_empty(
            text("url"), F.concat(F.lit(DISCUSSION_URL), F.col("id").cast("string"))
        ).alias("url"),
        F.timestamp_seconds(number("time")).alias("published_ts"),
        clean_text(text("text"), 500).alias("summary"),
        F.coalesce(number("score"), F.lit(0)).alias("hn_score"),
        F.coalesce(number("descendants"), F.lit(0)).alias("hn_comments"),
    )


def _listed(landed: DataFrame, parts: DataFrame) -> DataFrame:
    """Ids on the landed lists, once per date and source."""
    lists = landed_parts(landed, parts, "hackernews").filter(F.col("status") == "ok")
    return merge_lists(
        lists.withColumn("ids", F.from_json("body", "array<bigint>")), ["run_date", "source_config_id"])


def _found(landed: DataFrame, stories: DataFrame, parts: DataFrame) -> DataFrame:
    """Payloads of the stories on the landed lists, with the settings of their source; stories without one are skipped."""
    found = _listed(landed, parts).join(stories.filter(F.col("body").isNotNull()), ["run_date", "id"])
    settings = parts.filter((F.col("source_type") == "hackernews") & (F.col("part_pos") == 0)).select(
        "source_config_id", "source_type", "source_pos", "keywords", "require_keyword_match"
    )
    return found.join(F.broadcast(settings), "source_config_id")  # by source, all would come to one task


def _shown(items: DataFrame, *others: str) -> DataFrame:
    return items.select(
        "run_date",
        (position(F.col("source_pos"), F.lit(0), F.lit(0)) + F.col("ord")).alias("ord"),
        "source",
        "source_name",
        "source_id",
        "title",
        "url",
        iso_utc(F.col("published_ts")).alias("published_at"),
        "summary",
        popularity(hn_score=F.col("hn_score"), hn_comments=F.col("hn_comments")).alias(
            "raw_popularity"
        ),
        "source_config_id",
        "source_type",
        *others,
    )


def scan_stories(landed: DataFrame, stories: DataFrame, parts: DataFrame) -> DataFrame:
    """Items of the stories on the landed lists; stories without a payload are skipped."""
    items = story_items(_found(landed, stories, parts))
    return _shown(items.filter(on_date(F.col("published_ts"), F.col("run_date"))))


def read_stories(landed: DataFrame, stories: DataFrame, parts: DataFrame) -> DataFrame:
    """Items as of `scan_stories`, and next to them the listed payloads that are no JSON, marked `unreadable`."""
    unreadable = F.col("unreadable")
    marked = computed(_found(landed, stories, parts), unreadable=F.try_parse_json("body").isNull())
    items = story_items(marked, kept=unreadable)
    return _shown(items.filter(unreadable | on_date(F.col("published_ts"), F.col("run_date"))), "unreadable")


def unreadable_payloads(read: DataFrame) -> DataFrame:
    """Per date and source the first listed story whose payload is no JSON, as a reason to fail; of what `read_stories` gives."""
    first = read.filter("unreadable").groupBy("run_date", "source_config_id").agg(F.min_by("source_id", "ord").alias("id"))
    reason = F.concat(F.lit("story "), F.col("id"), F.lit(": payload is no JSON"))
    return first.select("run_date", "source_config_id", reason.alias("reason"))
