"""Enrichment: one projection from raw to scored items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.functions import scoring
from feedrank.functions.computed import computed
from feedrank.functions.text import first_non_empty, normalize_title, strip
from feedrank.functions.times import iso_utc, parse_iso
from feedrank.functions.urls import canonicalize_url, url_domain
from feedrank.params import Params


def content_hash(title: Column, domain: Column, source_id: Column) -> Column:
    """SHA-256 over the lower-cased title, the domain and the source id."""
    return F.sha2(F.concat_ws("|", F.lower(title), domain, source_id), 256)


def effective_source_id(source_id: Column, url: Column, title: Column) -> Column:
    return first_non_empty(source_id, url, title)


def with_identity(items: DataFrame, params: Params) -> DataFrame:
    """Normalised title, canonical URL and content hash; items without a title are dropped.

    Reads only title, URL and source id, so a plan that needs just the identity of the items
    does not scan their summaries.
    """
    url = strip(F.coalesce("url", F.lit("")))
    titled = computed(items, title=normalize_title(F.col("title"))).filter(F.col("title") != "")
    named = computed(
        titled,
        canonical_url=canonicalize_url(url, params.tracking_prefixes, params.tracking_params),
        title_norm=F.lower("title"),
    )
    digest = content_hash(
        F.col("title"),
        url_domain(first_non_empty(F.col("canonical_url"), url)),
        effective_source_id(F.col("source_id"), url, F.col("title")),
    )
    return computed(named, content_hash=digest)


def with_scores(items: DataFrame, now: Column, params: Params) -> DataFrame:
    """Normalised summary, tags, score and a filled-in publication time."""
    cleaned = computed(items, summary=normalize_title(F.col("summary")))
    text = computed(cleaned, _text=scoring.keyword_text(F.col("title"), F.col("summary")))
    tagged = computed(text, tags=scoring.keyword_tags(F.col("_text"), params)).drop("_text")
    total = scoring.score_sum(
        scoring.source_weight(F.col("source"), params),
        scoring.tag_score(F.col("tags"), params),
        scoring.popularity_score(F.col("source"), F.col("raw_popularity"), params),
        scoring.freshness_score(parse_iso(F.col("published_at"), now), now),
    )
    filled = F.coalesce(first_non_empty(F.col("published_at")), iso_utc(now))
    summed = computed(tagged, _total=total, published_at=filled)
    scored = computed(summed, score=scoring.round_cents(F.col("_total")))
    return scored.drop("_total")


def enrich(items: DataFrame, now: Column, params: Params = Params()) -> DataFrame:
    """Raw items to enriched items, as of `now`."""
    return with_scores(with_identity(items, params), now, params)
