"""Scores, tags and labels of an item."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedrank.functions.text import has_cjk
from feedrank.params import FRESHNESS_STEPS, OLD_ITEM_POINTS, Params

HOUR_MICROS = 3_600_000_000

NOT_TRANSLATED = "（原文为英文，未做机器翻译）"  # fixed value


def _lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    found = F.lit(None)
    for name, value in table.items():
        found = F.when(key == name, F.lit(value)).otherwise(found)
    return found


def source_weight(source: Column, params: Params) -> Column:
    return F.coalesce(_lookup(source, params.source_weights), F.lit(params.default_source_weight))


def source_label(source: Column, params: Params) -> Column:
    """Display name; other sources show their lower-cased key, or "-" if they have none."""
    key = F.lower(F.coalesce(source, F.lit("")))
    return F.coalesce(_lookup(key, params.source_labels), F.nullif(key, F.lit("")), F.lit("-"))


def keyword_text(title: Column, summary: Column) -> Column:
    """Lower-cased text for the keyword tests; no keyword spans title and summary."""
    return F.lower(F.concat(title, F.lit("\n"), summary))


def _holds(text: Column, keyword: str) -> Column:
    return F.contains(text, F.lit(keyword.lower()))


def _points(params: Params, found) -> Column:
    """Sum of the weights of the keywords for which `found` holds, up to the cap."""
    points = [
        F.when(found(keyword), float(weight)).otherwise(0.0)
        for keyword, weight in params.weighted_keywords()
    ]
    return F.least(reduce(lambda a, b: a + b, points, F.lit(0.0)), F.lit(params.keyword_cap))


def keyword_score(text: Column, params: Params) -> Column:
    """Points for the keywords in the text, each counted once."""
    return _points(params, lambda keyword: _holds(text, keyword))


def tag_score(tags: Column, params: Params) -> Column:
    """The same from the tags of the text, without searching it again."""
    return _points(params, lambda keyword: F.array_contains(tags, keyword))


def matched_keywords(text: Column, keywords: Iterable[str]) -> Column:
    """Sorted distinct keywords found in the text."""
    ordered = sorted(set(keywords))
    if not ordered:
        return F.array().cast("array<string>")
    hits = F.array(*(F.when(_holds(text, k), F.lit(k)) for k in ordered))
    return F.array_except(hits, F.array(F.lit(None).cast("string")))


def keyword_tags(text: Column, params: Params) -> Column:
    return matched_keywords(text, (k for k, _ in params.weighted_keywords()))


def any_keyword(text: Column, keywords: Column) -> Column:
    """Relevance: some keyword occurs in the lower-cased text, or there are no keywords."""
    hit = F.exists(keywords, lambda k: F.contains(text, F.lower(k)))
    return (F.size(keywords) == 0) | hit


def popularity_score(source: Column, popularity: Column, params: Params) -> Column:
    """Stars of repositories, or points and comments of stories, up to the cap."""

    def number(name: str) -> Column:
        return F.coalesce(popularity[name].cast("double"), F.lit(0.0))

    cap = F.lit(params.popularity_cap)
    stars = number("stars_today") / 25.0 + number("stars_total") / 50000.0
    votes = number("hn_score") / 12.0 + number("hn_comments") / 25.0
    return (
        F.when(source == "github", F.least(stars, cap))
        .when(source == "hn", F.least(votes, cap))
        .otherwise(0.0)
    )


def freshness_score(published: Column, now: Column) -> Column:
    """Points by age; the bounds are inclusive and the future counts as age zero."""
    age = F.unix_micros(now) - F.unix_micros(published)
    points = F.lit(OLD_ITEM_POINTS)
    for hours, value in reversed(FRESHNESS_STEPS):
        points = F.when(age <= hours * HOUR_MICROS, value).otherwise(points)
    return points


def round_cents(x: Column) -> Column:
    """Two decimals, rounded by the exact binary value of `x`, ties to even.

    Spark's own rounding goes through the shortest decimal text, so it sees ties where
    there are none. Whole and fractional part are exact doubles; the fraction times a power
    of two is a whole number, so the comparison with one half is done in integers.
    `x` should be a plain column, since it is used many times.
    """
    size = F.abs(x)
    whole = F.floor(size)
    fraction = size - whole
    unit = (
        F.when(size >= 1, F.lit(2**52)).when(size >= 2.0**-4, F.lit(2**56)).otherwise(F.lit(2**60))
    )
    hundredths = (fraction * unit.cast("double")).cast("bigint") * F.lit(100).cast("bigint")
    down = F.call_function("div", hundredths, unit)
    twice_rest = (hundredths % unit) * 2
    up = (twice_rest > unit) | ((twice_rest == unit) & (down % 2 == 1))
    cents = whole * 100 + down + F.when(up, 1).otherwise(0)
    return F.when(x < 0, -1.0).otherwise(1.0) * (cents.cast("double") / 100.0)


def score_sum(weight: Column, keywords: Column, popularity: Column, freshness: Column) -> Column:
    """The unrounded score; the order of the additions is part of the result."""
    return weight + keywords + popularity + freshness


def summary_line(summary: Column) -> Column:
    """The summary if it holds CJK text, a fixed remark if not, null if there is none."""
    return F.when(summary == "", None).when(has_cjk(summary), summary).otherwise(
        F.lit(NOT_TRANSLATED)
    )


def tag_line(tags: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(tags, ", "), F.lit("")), F.lit("-"))
