"""News items and landed fetches derived from the document, page and event tables.

The tables hold no feeds. Documents become articles: the first line is the headline, the whole
text the summary; pages give them addresses and events their times and popularity. Landed
fetches wrap the same documents as feed, trending-page and story bodies, in chunks of
neighbouring documents, so that the size of one body does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedrank.functions.times import iso_utc
from feedrank.functions.urls import url_domain
from feedrank.params import Params
from feedrank.sources.landing import popularity

NOW = "2024-01-31T00:00:00Z"
FIRST_DAY = "2024-01-01"

# The built-in keywords do not occur in the synthetic text; these do.
PARAMS = Params(
    keyword_groups={
        "core": ("the that", "that the"),
        "tools": ("eaux", "ción"),
        "mechanism": ("tion and",),
        "engineering": ("sch der",),
        "zh": ("en la",),
    }
)

FEED_CHUNK, PAGE_CHUNK, LIST_CHUNK = 50, 25, 60
FEED_SOURCES, FEED_PARTS = 7, 3
LANGUAGES = ("python", "cpp", "jupyter-notebook")
LISTS = ("top", "best", "new")
MAX_PER_LIST = 15
STORY_KEYWORDS = ("the", "eau", "ción")


# Known schemas spare every read a look at the files.
SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "benchmark": "item_id BIGINT, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def headline(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw items: every document, with a page's address and an event's time and numbers.

    Documents of equal length share a page, so copies share an address; every third
    document of a page gets its own query parameter. The tables are joined without the texts, which
    are attached once, at the end.
    """
    documents = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").cast("bigint").alias("votes"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    pages_in_all = pages.agg(F.count("*")).scalar()
    events_in_all = events.agg(F.count("*")).scalar()
    keyed = documents.select(
        "doc_id",
        "source",
        "n_chars",
        (F.char_length("text") % pages_in_all).alias("page_id"),
        (F.col("doc_id") * 7919 % events_in_all).alias("event_id"),
    )
    base = F.split_part("page_url", F.lit("#"), F.lit(1))
    glue = F.when(F.contains(base, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    narrow = keyed.join(pages, "page_id").join(events, "event_id")
    joined = documents.select("doc_id", "text").join(narrow, "doc_id")
    return joined.withColumn(
        "url", F.concat(base, glue, F.lit("d="), (F.col("doc_id") % 3).cast("string"))
    ).select(
        F.to_date("ts").alias("run_date"),
        F.col("doc_id").alias("ord"),
        F.element_at(F.array(*map(F.lit, ("rss", "github", "hn", "blog"))),
                     (F.col("doc_id") % 4 + 1).cast("int")).alias("source"),
        url_domain(F.col("url")).alias("source_name"),
        F.when(F.col("doc_id") % 5 != 0,
               F.concat_ws(":", "source", F.col("n_chars").cast("string"))).alias("source_id"),
        headline(F.col("text")).alias("title"),
        "url",
        F.when(F.col("doc_id") % 17 != 0, iso_utc(F.col("ts"))).alias("published_at"),
        F.col("text").alias("summary"),
        popularity(
            stars_total=F.col("k") * 250,
            stars_today=F.col("votes"),
            hn_score=F.col("votes"),
            hn_comments=F.col("k"),
        ).alias("raw_popularity"),
        F.col("source").alias("source_config_id"),
        F.element_at(F.array(*map(F.lit, ("rss", "github_trending", "hackernews", "blog"))),
                     (F.col("doc_id") % 4 + 1).cast("int")).alias("source_type"),
    )


def registry_documents(spark: SparkSession) -> DataFrame:
    """The registry that the landed fetches below belong to, as one JSON document."""
    feeds = ",".join(
        f'{{"id": " feed{i} ", "type": "RSS", "params": {{"urls": ['
        + ",".join(f'"https://feeds.example.com/{i}/{p}"' for p in range(FEED_PARTS))
        + "]}}"
        for i in range(FEED_SOURCES)
    )
    keywords = ",".join(f'"{k}"' for k in STORY_KEYWORDS)
    doc = (
        f'{{"sources": [{feeds}, {{"id": "trending", "type": "github_trending"}}, '
        f'{{"id": "stories", "type": "hackernews", "params": {{"max_per_feed": {MAX_PER_LIST}, '
        f'"keywords": [{keywords}]}}}}, {{"id": "off", "type": "rss", "enabled": false}}]}}'
    )
    return spark.createDataFrame([(doc,)], "doc STRING")


def _chunks(documents: DataFrame, size: int) -> DataFrame:
    chunk = F.floor(F.col("doc_id") / size)
    return documents.withColumn("chunk", chunk)


def _day(chunks_per_day: int) -> Column:
    days = F.floor(F.col("chunk") / chunks_per_day).cast("int")
    return F.date_add(F.lit(FIRST_DAY).cast("date"), days)


def _ordered(entry: Column) -> Column:
    """The entries of a chunk in document order; a chunk has a fixed number of documents."""
    rows = F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("entry"))))
    return F.transform(rows, lambda r: r["entry"])


def _published(run_date: Column) -> Column:
    """Some time on the run date, or on the day before for every fourth document."""
    day = F.unix_seconds(F.date_sub(run_date, F.when(F.col("doc_id") % 4 == 3, 1).otherwise(0))
                         .cast("timestamp"))
    return F.timestamp_seconds(day + F.col("doc_id") * 7919 % 86400)


def _landed(df: DataFrame, source_id: Column, part: Column, failed: Column, error: str,
            body: Column, fetched_at: Column) -> DataFrame:
    return df.select(
        "run_date",
        source_id.alias("source_config_id"),
        part.alias("part"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(failed, error).alias("error"),
        F.when(~failed, body).alias("body"),
        fetched_at.alias("fetched_at"),
    )


def landed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RSS body per chunk. Dates come as mail dates, as ISO dates, or in the link only."""
    chunks = _chunks(table(spark, sf_dir, "documents"), FEED_CHUNK)
    dated = chunks.withColumn("run_date", _day(FEED_SOURCES * FEED_PARTS)).withColumn(
        "published", _published(F.col("run_date"))
    )
    by_link = F.col("doc_id") % 10 == 9
    mail = F.date_format("published", "dd MMM yyyy HH:mm:ss '+0000'")
    link = F.when(
        by_link,
        F.concat(F.lit("https://News.example.com/issues/"), F.date_format("published", "yyyy-MM-dd"),
                 F.lit("-"), F.col("doc_id").cast("string")),
    ).otherwise(F.concat(F.lit("https://news.example.com/"), F.col("source"), F.lit("/"),
                         F.col("doc_id").cast("string")))
    entry = F.struct(
        headline(F.col("text")).alias("title"),
        link.alias("link"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("guid-"), F.col("doc_id").cast("string")))
        .alias("guid"),
        F.when(~by_link & (F.col("doc_id") % 2 == 0), F.concat(F.lit("Mon, "), mail)).alias("pubDate"),
        F.when(~by_link & (F.col("doc_id") % 2 == 1), iso_utc(F.col("published"))).alias("updated"),
        F.col("text").alias("description"),
    )
    feeds = dated.groupBy("run_date", "chunk").agg(_ordered(entry).alias("entries"))
    body = F.to_xml(
        F.struct(F.struct(F.col("entries").alias("item")).alias("channel")), {"rowTag": "rss"}
    )
    # Some feeds hold what XML forbids, some break off at their end, and some are no feeds.
    body = (
        F.when(F.col("chunk") % 11 == 5, F.lit("<html><body>Down for maintenance<br></body>"))
        .when(F.col("chunk") % 7 == 1, F.replace(
            body, F.lit("<channel>"), F.lit("<channel><generator>Salt & pepper&nbsp;\x01</generator>")))
        .when(F.col("chunk") % 7 == 2, F.regexp_replace(body, r"(?s)</channel>.*$", "<item><title>cut o"))
        .otherwise(body)
    )
    source = (F.col("chunk") % FEED_SOURCES).cast("string")
    part = (F.floor(F.col("chunk") / FEED_SOURCES) % FEED_PARTS).cast("string")
    return _landed(
        feeds,
        F.concat(F.lit("feed"), source),
        F.concat_ws("/", F.lit("https://feeds.example.com"), source, part),
        F.col("chunk") % 10 == 9,
        "HTTP 503",
        body,
        F.col("run_date").cast("timestamp"),
    )


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trending page per chunk. Every fifth page was taken a day late, one in nine failed."""
    chunks = _chunks(table(spark, sf_dir, "documents"), PAGE_CHUNK)
    dated = chunks.withColumn("run_date", _day(len(LANGUAGES)))
    name = F.concat(F.col("source"), F.lit("/ repo"), F.col("doc_id").cast("string"))
    row = F.format_string(
        '<article class="Box-row f4"><h2><a href="/%s"> x <b>y</b></a></h2>'
        '<p class="c"> %s\n <i>%s</i></p><a href="/z/stargazers"><svg/> %s </a>'
        '<span class="d-inline-block float-sm-right">%s stars today</span></article>',
        name,
        _escaped(F.col("text")),
        F.col("lang"),
        F.format_number(F.col("n_chars") * 7, 0),
        F.col("n_chars") % 997,
    )
    pages = dated.groupBy("run_date", "chunk").agg(
        F.concat(F.lit("<html><body><article>no row</article>"), F.array_join(_ordered(row), "\n"),
                 F.lit("</body></html>")).alias("body")
    )
    late = F.when(F.col("chunk") % 5 == 4, 1).otherwise(0)
    return _landed(
        pages,
        F.lit("trending"),
        F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("chunk") % 3 + 1).cast("int")),
        F.col("chunk") % 9 == 8,
        "HTTP 429",
        F.col("body"),
        F.date_add("run_date", late).cast("timestamp"),
    )


def landed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three story lists per chunk: in order, reversed, and its middle first. Some are no JSON."""
    chunks = _chunks(table(spark, sf_dir, "documents"), LIST_CHUNK)
    by_day = chunks.withColumn("run_date", _day(1)).groupBy("run_date", "chunk").agg(
        F.array_sort(F.collect_list("doc_id")).alias("ids")
    )
    half = F.floor(F.size("ids") / 2).cast("int")
    middle_first = F.concat(F.slice("ids", half + 1, F.size("ids")), F.slice("ids", F.lit(1), half))
    orders = {"top": F.col("ids"), "best": F.reverse("ids"), "new": middle_first}
    exploded = by_day.select(
        "run_date", "chunk",
        F.inline(F.array(*(
            F.struct(F.lit(name).alias("part"), ids.alias("ids")) for name, ids in orders.items()
        ))),
    )
    return _landed(
        exploded,
        F.lit("stories"),
        F.col("part"),
        (F.col("chunk") % 8 == 7) & (F.col("part") == "new"),
        "HTTP 500",
        F.when(F.col("chunk") % 8 == 5, F.concat(F.lit("<"), F.to_json("ids"))).otherwise(F.to_json("ids")),
        F.col("run_date").cast("timestamp"),
    )


def landed_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per document; some are no stories, some have no time, some are missing."""
    chunks = _chunks(table(spark, sf_dir, "documents"), LIST_CHUNK)
    dated = chunks.withColumn("run_date", _day(1))
    doc = F.col("doc_id")
    payload = F.to_json(F.struct(
        doc.alias("id"),
        F.when(doc % 11 == 10, "job").otherwise("story").alias("type"),
        headline(F.col("text")).alias("title"),
        F.col("text").alias("text"),
        F.when(doc % 6 != 5, F.concat(F.lit("https://stories.example.com/"), doc.cast("string"))).alias("url"),
        F.when(doc % 13 != 12, F.unix_seconds(_published(F.col("run_date")))).alias("time"),
        (F.col("n_chars") % 500).alias("score"),
        F.when(doc % 7 != 6, F.col("n_chars") % 90).alias("descendants"),
    ))
    return dated.select(
        "run_date", doc.alias("id"), F.when(doc % 19 != 18, payload).alias("body")
    )
