"""RSS, RDF and Atom feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.functions.computed import computed, once
from feedrank.functions.text import clean_text, first_non_empty, strip
from feedrank.functions.times import entry_timestamp, iso_utc, on_date
from feedrank.functions.urls import inner_base, resolved, source_name
from feedrank.sources.landing import landed_parts, popularity, position

_TEXT = "STRUCT<_VALUE: STRING, _type: STRING>"
_ENTRY = (
    f"STRUCT<`_xml:base`: STRING, title: {_TEXT}, "
    "link: ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING, `_xml:base`: STRING>>, "
    "guid: STRUCT<_VALUE: STRING, _isPermaLink: STRING>, id: STRING, `_rdf:about`: STRING, "
    "pubDate: STRING, published: STRING, `dc:date`: STRING, updated: STRING, "
    f"description: {_TEXT}, summary: {_TEXT}, content: {_TEXT}, `content:encoded`: {_TEXT}>"
)
# RSS items sit in the channel, RDF items and Atom entries under the root.
FEED_SCHEMA = (
    f"STRUCT<`_xml:base`: STRING, channel: STRUCT<`_xml:base`: STRING, item: ARRAY<{_ENTRY}>>, "
    f"item: ARRAY<{_ENTRY}>, entry: ARRAY<{_ENTRY}>>"
)


# Characters that XML forbids; an ampersand that starts no XML entity; a text element with markup in it;
# the whole entries of a feed that breaks off.
_FORBIDDEN = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"
_CONTROL = r"[\x00-\x1F&&[^\t\n\r]]"  # one comparison tells most characters
_STRAY = "&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9a-fA-F]+);)"
_MARKUP = (
    r"(?s)<(title|description|summary|content:encoded|content)((?:\s[^<>]*)?)(?<!/)>"
    r"([^<]*+<(?!!\[CDATA\[|/\1).*?)</\1\s*>"
)
_WHOLE_END = r"</(?:rss|feed|rdf:RDF|\w+:feed)\s*>\s*(?:<!--.*-->\s*)?$"


def mended(body: Column) -> Column:
    """A feed body that an XML parser reads: without forbidden characters and stray ampersands (names of
    HTML entities are kept as text, and resolved with the other text), markup inside of text elements
    taken as text, and closed behind its last whole entry if it breaks off."""

    def forbidden(b: Column) -> Column:
        return b.rlike(_CONTROL) | F.contains(b, F.lit("\uFFFE")) | F.contains(b, F.lit("\uFFFF"))

    allowed = once(body, lambda b: F.when(forbidden(b), F.regexp_replace(b, _FORBIDDEN, "")).otherwise(b))
    clean = once(allowed, lambda b: F.when(F.contains(b, F.lit("&")), F.regexp_replace(b, _STRAY, "&amp;")).otherwise(b))
    return once(F.regexp_replace(clean, _MARKUP, "<$1$2><![CDATA[$3]]></$1>"), _closed)


def _closed(text: Column) -> Column:
    """A feed that ends behind its last whole entry if it breaks off."""
    closed = (
        F.when(text.rlike("<rss[\\s>]"), F.regexp_replace(text, "(?s)^(.*</item\\s*>).*$", "$1</channel></rss>"))
        .when(text.rlike("<rdf:RDF[\\s>]"), F.regexp_replace(text, "(?s)^(.*</item\\s*>).*$", "$1</rdf:RDF>"))
        .otherwise(F.regexp_replace(text, "(?s)^(.*</entry\\s*>).*$", "$1</feed>"))
    )
    return F.when(text.rlike(_WHOLE_END), text).otherwise(closed)


def _feed_entries(feed: str) -> Column:
    return F.coalesce(F.col(f"{feed}.channel.item"), F.col(f"{feed}.item"), F.col(f"{feed}.entry"))


def unreadable_feeds(fetched: DataFrame) -> DataFrame:
    """Rows of fetched feeds, without the body, whose body is no feed even when mended: one without the root of a feed, or with entries of
    which none could be read."""
    others = [c for c in fetched.columns if c != "body"]
    parsed = computed(fetched.where("body IS NOT NULL"), feed=F.from_xml(mended(F.col("body")), FEED_SCHEMA))
    rootless = ~F.col("body").rlike(r"(?i)<(?:rss|feed|rdf:rdf|\w+:feed)[\s/>]")
    lost = F.col("body").rlike(r"<(?:item|entry)[\s>]")
    return parsed.filter(_feed_entries("feed").isNull() & (rootless | lost)).select(*others)


def parse_entries(feeds: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry, in document order (`row_pos`), next to the feed's other columns and the base address (`feed_base`)
    that the feed names for its links.

    Damaged bodies are mended first; one that is no feed gives no entries. Of an element that comes
    more than once in an entry, the last one counts.
    """
    feed = F.from_xml(mended(F.col(body)), FEED_SCHEMA)
    entries = _feed_entries("feed")
    base = inner_base(F.col("feed.`_xml:base`"), F.col("feed.channel.`_xml:base`"))
    base = F.coalesce(base, F.col("feed.channel.`_xml:base`"))
    others = [c for c in feeds.columns if c != body]
    return computed(feeds, feed=feed).select(
        *others, base.alias("feed_base"), F.posexplode(entries).alias("row_pos", "entry")
    )


def _entry(name: str) -> Column:
    return F.col(f"entry.`{name}`")


def _value(name: str) -> Column:
    return F.col(f"entry.`{name}`._VALUE")


def _links() -> tuple[Column, Column]:
    """The entry's first RSS link and its first Atom alternate link."""
    plain = F.filter(_entry("link"), lambda x: x["_VALUE"].isNotNull())
    alternate = F.filter(
        _entry("link"),
        lambda x: x["_href"].isNotNull() & (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"),
    )
    return F.try_element_at(plain, F.lit(1)), F.try_element_at(alternate, F.lit(1))


def entry_link() -> Column:
    """The entry's link as it is written: an RSS link, an Atom alternate link, or a guid that is a permalink."""
    plain, alternate = _links()
    permalink = F.when(
        F.coalesce(F.lower(F.col("entry.guid._isPermaLink")), F.lit("true")) == "true", _value("guid")
    )
    return strip(first_non_empty(plain["_VALUE"], alternate["_href"], permalink))


def link_base() -> Column:
    """The base address that the element of the entry's link names itself."""
    plain, alternate = _links()
    return F.when(first_non_empty(plain["_VALUE"]).isNotNull(), plain["_xml:base"]).when(
        first_non_empty(alternate["_href"]).isNotNull(), alternate["_xml:base"])


def _linked(entries: DataFrame) -> DataFrame:
    """Entries that have a link, with its address: resolved where the feed, the entry or the link names a base address."""
    own = _entry("_xml:base")
    based = computed(entries, entry_base=F.coalesce(inner_base(F.col("feed_base"), own), own))
    written = computed(
        based, link=entry_link(), link_base=F.coalesce(inner_base(F.col("entry_base"), link_base()), link_base())
    ).filter(F.col("link").isNotNull())
    return computed(written, url=resolved(F.col("link_base"), F.col("link")))


def entry_items(entries: DataFrame) -> DataFrame:
    """Item fields of entries; entries without title or link are dropped."""
    published = first_non_empty(_entry("pubDate"), _entry("published"))
    updated = first_non_empty(_entry("updated"), _entry("dc:date"))
    summary = first_non_empty(
        _value("content:encoded"), _value("content"), _value("summary"), _value("description")
    )
    others = [c for c in entries.columns if c not in ("entry", "feed_base")]
    dated = computed(_linked(entries), published_ts=entry_timestamp(published, updated, F.col("url")))
    titled = computed(dated, title=clean_text(_value("title"), 300)).filter(F.col("title") != "")
    return titled.select(
        *others,
        F.lit("rss").alias("source"),
        source_name(F.col("url")).alias("source_name"),
        first_non_empty(
            _value("guid"), _entry("id"), _entry("_rdf:about"), F.col("url")
        ).alias("source_id"),
        "title",
        "url",
        "published_ts",
        clean_text(summary).alias("summary"),
    )


def scan_feeds(landed: DataFrame, parts: DataFrame) -> DataFrame:
    """Items of all landed feeds whose entries are of the run date."""
    fetched = landed_parts(landed, parts, "rss").filter(F.col("status") == "ok")
    feeds = fetched.select(
        "run_date", "source_config_id", "source_type", "source_pos", "part_pos", "body"
    )
    return (
        entry_items(parse_entries(feeds))
        .filter(on_date(F.col("published_ts"), F.col("run_date")))
        .select(
            "run_date",
            position(F.col("source_pos"), F.col("part_pos"), F.col("row_pos")).alias("ord"),
            "source",
            "source_name",
            "source_id",
            "title",
            "url",
            iso_utc(F.col("published_ts")).alias("published_at"),
            "summary",
            popularity().alias("raw_popularity"),
            "source_config_id",
            "source_type",
        )
    )
