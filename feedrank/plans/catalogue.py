"""Registered queries: each operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedrank.functions import scoring, text, times, urls
from feedrank.operators.dedup import dedup, first_per_key
from feedrank.operators.enrich import content_hash, effective_source_id, enrich, with_identity
from feedrank.operators.keyword_table import table_hits, table_points
from feedrank.operators.keywords import keyword_hits
from feedrank.operators.rank import select_candidates, top_n
from feedrank.operators.stats import run_stats, source_counts
from feedrank.params import Params
from feedrank.plans import tables
from feedrank.plans.daily import daily_run, daily_top, deduplicated
from feedrank.plans.tables import PARAMS, table
from feedrank.session import shared_folder, stored
from feedrank.sinks.raw import read_raw, run_header, write_raw
from feedrank.sinks.report import preview, report_blocks
from feedrank.sources import bodies
from feedrank.sources.collect import collect_items, fetch_warnings
from feedrank.sources.feeds import scan_feeds
from feedrank.sources.registry import (
    DEFAULT_STORY_KEYWORDS,
    clean_list,
    parse_registry,
    parse_source_ids,
    parse_sources,
    select_sources,
    source_parts,
)
from feedrank.sources.stories import merge_lists, scan_stories
from feedrank.sources.trending import scan_trending

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its name; a trailing underscore tells it from an operator."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def now() -> Column:
    return times.as_timestamp(tables.NOW)


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(tables.items(spark, sf_dir), now(), PARAMS)


def _shown(items: DataFrame, *extra: str) -> DataFrame:
    """Items with plain columns: the date as text, the tags joined."""
    return items.select(
        F.col("run_date").cast("string").alias("run_date"),
        "ord",
        *extra,
        "source",
        "title",
        "url",
        "published_at",
        "score",
        F.array_join("tags", ",").alias("tags"),
    )


# --- addresses ---------------------------------------------------------------


@query
def url_canonical(spark, sf_dir):
    """Page addresses as they are, and item addresses with awkward query strings."""
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url"
    )
    awkward = F.concat(
        F.lit(" HTTPS://User@Example.COM:80/"), "source", F.lit("//?UTM_X=1&Ref=2&e&&q="),
        F.translate("text", "%\n", " "), F.lit("&t=a+b%20~*#top"),
    )
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), awkward.alias("url")
    )
    return pages.unionByName(documents).select(
        "kind", "id", urls.canonicalize_url(F.col("url")).alias("canonical_url")
    )


@query
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.url_domain(F.upper("url")).alias("domain")
    )


@query
def source_name(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.source_name(F.col("url")).alias("name"),
        urls.source_name(path).alias("name_without_host"),
    )


@query
def link_resolve(spark, sf_dir):
    """References of twelve kinds, each with a whole text in it, inside of documents with an address."""
    tail = F.concat(F.lit("t"), F.translate(F.coalesce("text", F.lit("")), "/?#:", "    "))
    base = F.concat(
        F.lit("http://"), F.coalesce("source", F.lit("none")), F.lit(".example.com/"), F.coalesce("lang", F.lit("und")),
        F.lit("/b/c;p?q="), F.col("doc_id").cast("string"),
    )
    kinds = F.array(*(
        F.concat(F.lit(before), F.col("tail"), F.lit(after)) for before, after in (
            ("g", ""), ("./", "/."), ("../", ""), ("../../../", "/x/.."), ("/x/./y/../", ""), ("//Other.example.com/", ""),
            ("?y=", ""), ("#", ""), ("https://else.example.com/a/../", ""), ("mailto:", ""), ("g/../", "?a/../b"),
        )
    ))
    documents = table(spark, sf_dir, "documents").select("doc_id", tail.alias("tail"), base.alias("base"))
    reference = F.coalesce(F.try_element_at(kinds, (F.pmod(F.col("doc_id"), F.lit(12)) + 1).cast("int")), F.lit(""))
    return documents.select("doc_id", "base", reference.alias("reference")).select(
        "doc_id", urls.resolved(F.col("base"), F.col("reference")).alias("url"))


@query
def link_date(spark, sf_dir):
    ts = F.col("ts")
    pattern = F.element_at(
        F.array(
            F.date_format(ts, "yy-MM-dd"),
            F.date_format(ts, "yyyy-MM-dd"),
            F.date_format(ts, "'24-02-'dd"),
            F.date_format(ts, "yyyyMMdd"),
        ),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    link = F.concat(F.lit("https://news.example.com/issues/"), pattern, F.lit("-"), "event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", urls.link_date(link).cast("string").alias("link_date")
    )


# --- text --------------------------------------------------------------------


@query
def title_normalize(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("raw")
    )
    return (
        documents.unionByName(pages)
        .select("kind", "id", text.normalize_title(F.col("raw")).alias("title"))
        .filter(F.col("title") != "")
        .withColumn("title_norm", F.lower("title"))
    )


@query
def text_truncate(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("raw")
    )
    return documents.unionByName(pages).select(
        "kind",
        "id",
        text.clean_text(F.col("raw"), 300).alias("title"),
        text.clean_text(F.col("raw")).alias("summary"),
    )


@query
def digits_to_int(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.digits_to_int(F.col("props")).alias("k"),
        text.digits_to_int(F.concat(F.col("value").cast("string"), F.lit("k stars"))).alias("stars"),
        text.digits_to_int(F.col("event_type")).alias("none"),
    )


@query
def cjk_summary(spark, sf_dir):
    """Summaries of documents; German ones get a CJK ending, Spanish ones are emptied."""
    shown = (
        F.when(F.col("lang") == "de", F.concat("text", F.lit(" 智能编码")))
        .when(F.col("lang") == "es", F.lit(""))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", scoring.summary_line(shown).alias("summary_line")
    )


@query
def param_list_clean(spark, sf_dir):
    """List parameters: the lines of a document, its language alone, or none."""
    kind = F.col("doc_id") % 4
    value = (
        F.when(kind == 0, F.parse_json(F.to_json("lang")))
        .when(kind == 1, F.parse_json(F.lit("null")))
        .otherwise(F.parse_json(F.to_json(F.split("lines", "\n"))))
    )
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.struct(F.concat(F.lit("\t"), "lang", F.lit(" ")).alias("v")).alias("lang"),
        F.concat(F.lit(" \n"), "text", F.lit("\n\n")).alias("lines"),
    )
    scalar = F.variant_get(value, "$.v", "variant")
    cleaned = clean_list(F.when(kind == 0, scalar).otherwise(value))
    return documents.select(
        "doc_id", F.size(cleaned).alias("n"), F.array_join(cleaned, "|").alias("items")
    )


# --- identity ----------------------------------------------------------------


@query
def content_hash_(spark, sf_dir):
    return with_identity(tables.items(spark, sf_dir), PARAMS).select("ord", "content_hash")


@query
def defaults_fill(spark, sf_dir):
    items = tables.items(spark, sf_dir)
    return items.select(
        "ord",
        effective_source_id(F.col("source_id"), F.col("url"), F.col("title")).alias("source_id"),
        F.coalesce(
            text.first_non_empty(F.col("published_at")), times.iso_utc(now())
        ).alias("published_at"),
    )


# --- times -------------------------------------------------------------------


@query
def iso_time(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    written = F.when(F.col("event_id") % 9 != 8, times.iso_utc(ts))
    events = table(spark, sf_dir, "events").select("event_id", written.alias("iso"))
    parsed = times.parse_iso(F.col("iso"), now())
    return events.select("event_id", "iso", F.unix_micros(parsed).alias("micros"))


@query
def entry_timestamp(spark, sf_dir):
    """Feed dates written as mail dates with several zones, as ISO dates, or in the link."""
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 8
    published = (
        F.when(kind == 0, F.concat(F.lit("Mon, "), F.date_format(ts, "dd MMM yyyy HH:mm:ss 'GMT'")))
        .when(kind == 1, F.date_format(ts, "d MMM yy HH:mm 'EST'"))
        .when(kind == 2, F.date_format(ts, "dd MMM yyyy HH:mm:ss '+0530'"))
        .when(kind == 3, times.iso_utc(ts))
        .when(kind == 4, F.lit("not a date"))
    )
    updated = (
        F.when(kind == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'-02:00'"))
        .when(kind == 5, F.date_format(ts, "yyyy-MM-dd"))
    )
    link = F.when(kind == 6, F.concat(F.lit("/issues/"), F.date_format(ts, "yy-MM-dd"), F.lit("-x")))
    events = table(spark, sf_dir, "events").select(
        "event_id", published.alias("published"), updated.alias("updated"), link.alias("link")
    )
    found = times.entry_timestamp(F.col("published"), F.col("updated"), F.col("link"))
    return events.select("event_id", times.iso_utc(found).alias("entry_time"))


@query
def date_filter(spark, sf_dir):
    """Events of the day before a given date."""
    day = times.run_date("yesterday", as_of=times.run_date(explicit="2024-01-16"))
    return (
        table(spark, sf_dir, "events")
        .filter(times.on_date(F.col("ts"), F.lit(day)))
        .select("event_id", "event_type", times.iso_utc(F.col("ts")).alias("ts"))
    )


@query
def snapshot_gate(spark, sf_dir):
    """Snapshots count for the date they were taken on; every third is asked for a day late."""
    late = F.when(F.col("event_id") % 3 == 2, 1).otherwise(0)
    return (
        table(spark, sf_dir, "events")
        .withColumn("run_date", F.date_add(F.to_date("ts"), late))
        .filter(times.on_date(F.col("ts"), F.col("run_date")))
        .select("event_id", F.col("run_date").cast("string").alias("run_date"))
    )


# --- scores ------------------------------------------------------------------


@query
def keyword_tags(spark, sf_dir):
    tags = scoring.keyword_tags(F.lower("text"), PARAMS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


@query
def keyword_score(spark, sf_dir):
    """Points under the test keywords and, for pages too, under the built-in ones."""
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lower("text").alias("hay")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.lower("html").alias("hay")
    )
    return documents.unionByName(pages).select(
        "kind",
        "id",
        scoring.keyword_score(F.col("hay"), PARAMS).alias("points"),
        scoring.keyword_score(F.col("hay"), Params()).alias("built_in_points"),
    )


@query
def keyword_relevance(spark, sf_dir):
    keywords = F.array(*map(F.lit, DEFAULT_STORY_KEYWORDS))
    return (
        table(spark, sf_dir, "documents")
        .filter(scoring.any_keyword(F.lower("text"), keywords))
        .select("doc_id")
    )


@query
def keyword_join(spark, sf_dir):
    hits = keyword_hits(table(spark, sf_dir, "documents"), F.col("text"), PARAMS)
    return hits.select("doc_id", "keyword_group", "keyword", "weight")


def _table_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword table: the words of at least six letters of the benchmark items, and how each item begins."""
    items = table(spark, sf_dir, "benchmark")
    words = items.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"), 1)).alias("keyword")).select(
        F.concat(F.lit("letters "), (F.length("keyword") % 5).cast("string")).alias("keyword_group"), "keyword",
        (F.length("keyword") % 4 + 0.1).cast("double").alias("weight"))
    begins = items.select(
        F.lit("begin").alias("keyword_group"), F.substring("text", 1, 90).alias("keyword"), F.lit(7.5).alias("weight"))
    return words.unionByName(begins)


def _table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return table_hits(documents, F.col("text"), _table_keywords(spark, sf_dir), ["doc_id"])


@query
def keyword_table_join(spark, sf_dir):
    """Documents with the keywords of a table that grows by itself."""
    return _table_hits(spark, sf_dir)


@query
def keyword_table_score(spark, sf_dir):
    """Points of all documents by that table, with a cap."""
    points = table_points(_table_hits(spark, sf_dir), ["doc_id"], 60.0)
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return documents.join(points, "doc_id", "left").select("doc_id", F.coalesce("points", F.lit(0.0)).alias("points"))


@query
def popularity_score(spark, sf_dir):
    k, votes = F.get_json_object("props", "$.k").cast("bigint"), F.col("value").cast("bigint")
    numbers = F.struct(
        votes.alias("stars_today"), (k * 25_000).alias("stars_total"),
        votes.alias("hn_score"), k.alias("hn_comments"),
    )
    events = table(spark, sf_dir, "events").select("event_id", numbers.alias("numbers"))

    def points(source: str) -> Column:
        return scoring.popularity_score(F.lit(source), F.col("numbers"), PARAMS).alias(source)

    return events.select("event_id", points("github"), points("hn"), points("rss"))


@query
def freshness_score(spark, sf_dir):
    """Ages from zero to thirty days; whole hours for every other event."""
    ts = F.col("ts").cast("timestamp")
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.date_trunc("hour", ts)).otherwise(ts).alias("ts"),
    )
    early = times.as_timestamp("2024-01-20T00:00:00Z")
    return events.select(
        "event_id",
        scoring.freshness_score(F.col("ts"), now()).alias("points"),
        scoring.freshness_score(F.col("ts"), early).alias("early_points"),
    )


def _kind_of_line() -> Column:
    kinds = F.array(*map(F.lit, ("rss", "github", "hn", "RSS", "blog")))
    return F.element_at(kinds, (F.col("l_orderkey") % 5 + 1).cast("int"))


@query
def source_weight(spark, sf_dir):
    weight = scoring.source_weight(_kind_of_line(), PARAMS)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", weight.alias("weight")
    )


@query
def source_label(spark, sf_dir):
    label = scoring.source_label(_kind_of_line(), PARAMS)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        label.alias("label"),
        scoring.source_label(F.nullif("l_returnflag", F.lit("N")), PARAMS).alias("flag_label"),
    )


@query
def total_score(spark, sf_dir):
    """Line items as repositories; part keys give many exact rounding ties."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        _kind_of_line().alias("source"),
        F.struct(
            F.col("l_quantity").cast("bigint").alias("stars_today"),
            (F.col("l_partkey") * 250).alias("stars_total"),
            F.col("l_suppkey").alias("hn_score"),
            F.col("l_quantity").cast("bigint").alias("hn_comments"),
        ).alias("numbers"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_tax").alias("tax"),
    )
    total = scoring.score_sum(
        scoring.source_weight(F.col("source"), PARAMS),
        F.col("tax") * 100.0,
        scoring.popularity_score(F.col("source"), F.col("numbers"), PARAMS),
        scoring.freshness_score(F.col("ts"), times.as_timestamp("1998-06-01T00:00:00Z")),
    )
    return lines.select("l_orderkey", "l_linenumber", total.alias("total")).select(
        "l_orderkey", "l_linenumber", scoring.round_cents(F.col("total")).alias("score")
    )


# --- de-duplication ----------------------------------------------------------


@query
def dedup_items(spark, sf_dir):
    """All items as one run."""
    identified = with_identity(tables.items(spark, sf_dir), PARAMS)
    kept = dedup(identified, scope=())
    return kept.select("ord", "canonical_url", "content_hash")


@query
def dedup_items_by_day(spark, sf_dir):
    kept = deduplicated(tables.items(spark, sf_dir), now(), PARAMS)
    return kept.select(F.col("run_date").cast("string").alias("run_date"), "ord", "score")


def _linked(df: DataFrame, url: Column, title: Column) -> DataFrame:
    """Documents as items with made-up keys; copies of a text share their hash."""
    digest = F.sha2(F.col("text"), 256)
    return df.select(
        F.col("doc_id").alias("ord"), url.alias("canonical_url"), title.alias("title_norm"), digest.alias("content_hash"))


@query
def dedup_hot_key(spark, sf_dir):
    """A third of all documents on one address, and another third with one title, mostly on one host."""
    doc = F.col("doc_id")
    url = F.when(doc % 3 == 0, F.lit("http://hot.example.com/one")).otherwise(
        F.concat(F.lit("http://h"), (F.greatest(doc % 9 - 5, F.lit(0))).cast("string"), F.lit(".example.com/"), doc.cast("string")))
    title = F.when(doc % 3 == 1, F.lit("one title")).otherwise(F.concat(F.lit("title "), doc.cast("string")))
    return dedup(_linked(table(spark, sf_dir, "documents"), url, title), scope=()).select("ord", "canonical_url")


@query
def dedup_long_chain(spark, sf_dir):
    """Every document shares its address with one neighbour and its title with the other."""
    doc = F.col("doc_id")
    url = F.concat(F.lit("http://chain.example.com/"), F.floor((doc + 1) / 2).cast("string"))
    title = F.concat(F.lit("title "), F.floor(doc / 2).cast("string"))
    return dedup(_linked(table(spark, sf_dir, "documents"), url, title), scope=()).select("ord", "canonical_url")


@query
def dedup_braid(spark, sf_dir):
    """Every document shares one key or another with the two before it, and copies share their hash, too."""
    doc = F.col("doc_id")
    url = F.concat(F.lit("http://braid.example.com/"), F.floor(doc / 3).cast("string"))
    title = F.concat(F.lit("title "), F.floor((doc + F.when(doc % 1000 < 700, 1).otherwise(2)) / 3).cast("string"))
    return dedup(_linked(table(spark, sf_dir, "documents"), url, title), scope=()).select("ord", "canonical_url")


@query
def dedup_single_key(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return first_per_key(events, ["user_id", "event_type"], "event_id")


# --- selection and ranking ---------------------------------------------------


@query
def enrich_items(spark, sf_dir):
    return _shown(
        _enriched(spark, sf_dir), "source_id", "summary", "canonical_url", "title_norm", "content_hash"
    )


@query
def threshold_select(spark, sf_dir):
    return select_candidates(_enriched(spark, sf_dir), PARAMS.threshold).select("ord", "score")


@query
def top_n_global(spark, sf_dir):
    best = top_n(_enriched(spark, sf_dir), 25, now(), by=())
    return preview(best).drop("run_date")


@query
def top_n_per_day(spark, sf_dir):
    return _shown(top_n(_enriched(spark, sf_dir), 5, now()), "rank")


@query
def daily_top_news(spark, sf_dir):
    """The whole run: enrich, de-duplicate by day, select, rank."""
    return _shown(daily_top(tables.items(spark, sf_dir), now(), PARAMS), "rank", "summary")


@query
def daily_one_date(spark, sf_dir):
    """The whole run for one date of the archive."""
    top = daily_top(tables.items(spark, sf_dir), now(), PARAMS, dates=["2024-01-29"])
    return _shown(top, "rank", "summary")


# --- statistics and reports --------------------------------------------------


@query
def run_stats_(spark, sf_dir):
    items = tables.items(spark, sf_dir)
    kept = deduplicated(items, now(), PARAMS)
    stats = run_stats(items, kept, PARAMS.threshold, PARAMS.top_n, now())
    return stats.withColumn("run_date", F.col("run_date").cast("string"))


@query
def source_counts_(spark, sf_dir):
    counts = source_counts(tables.items(spark, sf_dir))
    return counts.withColumn("run_date", F.col("run_date").cast("string"))


@query
def report_blocks_(spark, sf_dir):
    blocks = report_blocks(daily_top(tables.items(spark, sf_dir), now(), PARAMS), PARAMS)
    return blocks.withColumn("run_date", F.col("run_date").cast("string"))


@query
def report_documents_(spark, sf_dir):
    run = daily_run(tables.items(spark, sf_dir), now(), PARAMS)
    return run.reports.withColumn("run_date", F.col("run_date").cast("string"))


@query
def raw_items(spark, sf_dir):
    """The raw JSON output as it is read back: kept items, each with the statistics of its date."""
    run = daily_run(tables.items(spark, sf_dir), now(), PARAMS)
    header = run_header(run.stats, None, ["all"])
    path = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    write_raw(run.deduped, header, path)
    written = read_raw(spark, path, run.deduped.schema, header.schema)
    return _shown(written, "summary", "canonical_url", "title_norm", "content_hash", "total_fetched", "after_dedup", "generated_at")


# --- sources -----------------------------------------------------------------


def _parts(spark: SparkSession) -> DataFrame:
    return source_parts(_sources(spark))


def _shown_raw(items: DataFrame) -> DataFrame:
    return items.select(
        F.col("run_date").cast("string").alias("run_date"),
        "ord",
        "source",
        "source_name",
        "source_id",
        "title",
        "url",
        "published_at",
        "summary",
        "raw_popularity.*",
        "source_config_id",
        "source_type",
    )


@query
def scan_feed_items(spark, sf_dir):
    return _shown_raw(scan_feeds(tables.landed_feeds(spark, sf_dir), _parts(spark)))


@query
def scan_feed_relative(spark, sf_dir):
    """The same feeds with relative links, below a base address of the channel and, for some, of the item."""
    landed = tables.landed_feeds(spark, sf_dir)
    site, some = "https://news.example.com/", F.pmod(F.xxhash64("source_config_id", "part", "run_date"), F.lit(2)) == 0
    body = F.replace(F.col("body"), F.lit("<channel>"), F.lit(f'<channel xml:base="{site}feeds/all.xml">'))
    shallow = F.replace(body, F.lit(f"<link>{site}"), F.lit("<link>../"))
    deep = F.replace(F.replace(body, F.lit("<item>"), F.lit('<item xml:base="../a/b/./">')),
                     F.lit(f"<link>{site}"), F.lit("<link>../../"))
    return _shown_raw(scan_feeds(landed.withColumn("body", F.when(some, deep).otherwise(shallow)), _parts(spark)))


@query
def scan_feed_bytes(spark, sf_dir):
    """The same feeds landed as bytes: UTF-8, UTF-16 with a mark, and Windows-1252 and GB18030 by declaration or header."""
    landed, kind = tables.landed_feeds(spark, sf_dir), F.pmod(F.xxhash64("source_config_id", "part", "run_date"), F.lit(6))

    def declared(name: str) -> Column:
        return F.concat(F.lit(f"<?xml version='1.0' encoding='{name}'?>"), "body")

    content = (
        F.when(kind == 0, bodies.encoded(F.col("body"), "UTF-8")).when(kind == 1, bodies.encoded(F.col("body"), "UTF-16LE"))
        .when(kind == 2, bodies.encoded(declared("ISO-8859-1"), "windows-1252"))
        .when(kind == 3, bodies.encoded(declared("gb2312"), "GB18030"))
        .when(kind == 4, bodies.encoded(F.col("body"), "GB18030")).otherwise(bodies.encoded(F.col("body"), "UTF-16BE")))
    content_type = F.when(kind == 4, "text/xml; charset=GBK").when(kind == 0, "text/xml; charset=unknown")
    fetched = landed.withColumn("content", content).withColumn("content_type", content_type)
    read = fetched.withColumn("body", bodies.decoded(F.col("content"), F.col("content_type"))).drop("content", "content_type")
    return _shown_raw(scan_feeds(read, _parts(spark)))


@query
def scan_html_rows(spark, sf_dir):
    return _shown_raw(scan_trending(tables.landed_pages(spark, sf_dir), _parts(spark)))


@query
def feed_merge_distinct(spark, sf_dir):
    lists = tables.landed_lists(spark, sf_dir).join(_parts(spark), ["source_config_id", "part"])
    merged = merge_lists(
        lists.filter("status = 'ok'").withColumn("ids", F.from_json("body", "array<bigint>")),
        ["run_date", "source_config_id"],
    )
    return merged.withColumn("run_date", F.col("run_date").cast("string"))


@query
def story_scan_join(spark, sf_dir):
    lists = stored(tables.landed_lists(spark, sf_dir), "lists")  # as landed: no longer an expression
    return _shown_raw(scan_stories(lists, tables.landed_stories(spark, sf_dir), _parts(spark)))


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = (
        tables.landed_feeds(spark, sf_dir)
        .unionByName(tables.landed_pages(spark, sf_dir))
        .unionByName(tables.landed_lists(spark, sf_dir))
    )
    return stored(landed, "landed")  # a lander would have stored it


def _sources(spark: SparkSession) -> DataFrame:
    return select_sources(parse_registry(tables.registry_documents(spark)))


@query
def source_union(spark, sf_dir):
    landed, stories = _landed(spark, sf_dir), tables.landed_stories(spark, sf_dir)
    return _shown_raw(collect_items(landed, stories, _sources(spark)))


@query
def fetch_failure_policy(spark, sf_dir):
    warnings = fetch_warnings(_landed(spark, sf_dir), _sources(spark))
    return warnings.withColumn("run_date", F.col("run_date").cast("string"))


def _retried(landed: DataFrame) -> DataFrame:
    """Every second part was tried before and failed; what succeeded was fetched once more, in vain; and some failed twice."""
    some = F.pmod(F.xxhash64("source_config_id", "part", "run_date"), F.lit(2)) == 0
    earlier = landed.where(some).withColumns({
        "status": F.lit("failed"), "error": F.lit("timed out"), "body": F.lit(None).cast("string"),
        "fetched_at": F.col("fetched_at") - F.expr("INTERVAL 1 HOUR")})
    later = landed.where((F.col("status") == "ok") & some).withColumns({
        "body": F.lit("<html>busy</html>"), "fetched_at": F.col("fetched_at") + F.expr("INTERVAL 30 DAYS")})
    return landed.unionByName(earlier).unionByName(later)


@query
def retried_items(spark, sf_dir):
    """The items of sources whose parts were fetched several times: the same as of their settled fetches."""
    landed, stories = _retried(_landed(spark, sf_dir)), tables.landed_stories(spark, sf_dir)
    return _shown_raw(collect_items(landed, stories, _sources(spark)))


@query
def fetch_retries(spark, sf_dir):
    """The warnings for such sources."""
    warnings = fetch_warnings(_retried(_landed(spark, sf_dir)), _sources(spark))
    return warnings.withColumn("run_date", F.col("run_date").cast("string"))


@query
def registry_select(spark, sf_dir):
    """Documents of the selected sources, where each document source is a registry entry."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    specs = (
        table(spark, sf_dir, "documents").select("source").distinct().select(
            number.alias("source_pos"),
            F.parse_json(F.to_json(F.struct(
                F.concat(F.lit(" "), "source").alias("id"),
                F.element_at(F.array(*map(F.lit, ("rss", "Github_Trending", "hackernews"))),
                             number % 3 + 1).alias("type"),
                F.when(number % 4 == 3, F.lit(False)).alias("enabled"),
            ))).alias("spec"),
        )
    )
    chosen = select_sources(parse_sources(specs), parse_source_ids("src4, hn ,src1,src4"))
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"))
    return counts.join(chosen, counts.source == chosen.source_config_id).select(
        "source_config_id", "source_type", "source_pos", "documents"
    )
