import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from feedrank.schemas import LANDED, LANDED_STORY
from feedrank.sources import feeds
from feedrank.sources.collect import collect
from feedrank.sources.registry import (
    DEFAULT_PARTS,
    DEFAULT_STORY_KEYWORDS,
    check_registry,
    default_registry,
    parse_registry,
    parse_source_ids,
    read_registry,
    select_sources,
    source_parts,
)
from feedrank.sources.stories import merge_lists

DAY = dt.date(2024, 1, 1)
NOON = dt.datetime(2024, 1, 1, 12)

REGISTRY = {
    "sources": [
        {"id": " one ", "type": " RSS ", "params": {"urls": [" u1 ", "", "u2"]}},
        {"id": "two", "type": "rss", "enabled": True, "params": {"urls": "u3"}},
        {"id": "off", "type": "rss", "enabled": False},
        {"id": "null", "type": "rss", "enabled": None},
        {"id": "text", "type": "rss", "enabled": "false"},
        {"id": "trend", "type": "github_trending", "params": {"languages": ["python", "cpp"]}},
        {"id": "stories", "type": "hackernews",
         "params": {"max_per_feed": 0, "keywords": ["AI"], "require_keyword_match": True}},
        {"id": "odd", "type": "carrier-pigeon"},
    ]
}


@pytest.fixture(scope="module")
def registry(spark):
    return parse_registry(spark.createDataFrame([(json.dumps(REGISTRY),)], "doc string"))


def _ids(sources):
    return [r.source_config_id for r in sources.orderBy("source_pos").collect()]


def test_registry_values_and_defaults(registry):
    rows = {r.source_config_id: r for r in registry.collect()}
    assert [r.source_config_id for r in registry.orderBy("source_pos").collect()] == [
        "one", "two", "off", "null", "text", "trend", "stories", "odd",
    ]
    assert rows["one"].source_type == "rss" and rows["one"].parts == ["u1", "u2"]
    assert rows["two"].parts == ["u3"] and rows["off"].parts == list(DEFAULT_PARTS["rss"])
    assert [n for n, r in rows.items() if not r.enabled] == ["off", "null"]
    assert rows["trend"].since == "daily" and rows["odd"].parts == []
    assert rows["stories"].max_per_feed == 1 and rows["stories"].parts == ["top", "best", "new"]
    assert rows["stories"].keywords == ["AI"] and rows["one"].keywords == list(DEFAULT_STORY_KEYWORDS)


def test_registry_file(spark, tmp_path, registry):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps(REGISTRY, indent=2))
    assert sorted(read_registry(spark, str(path)).collect()) == sorted(registry.collect())


def test_source_without_id_aborts(spark):
    doc = json.dumps({"sources": [{"type": "rss"}]})
    with pytest.raises(Exception, match="source without id at position 0"):
        parse_registry(spark.createDataFrame([(doc,)], "doc string")).collect()


def test_registry_checks(spark, registry):
    check_registry(registry)
    for sources, message in (([], "no sources"), ([{"id": "a", "type": "rss"}] * 2, "more than once: a")):
        doc = json.dumps({"sources": sources})
        with pytest.raises(ValueError, match=message):
            check_registry(parse_registry(spark.createDataFrame([(doc,)], "doc string")))


def test_default_registry(spark):
    rows = default_registry(spark).orderBy("source_pos").collect()
    assert len(rows) == 21 and all(r.enabled for r in rows)
    assert rows[0].parts == list(DEFAULT_PARTS["rss"])
    (stories,) = [r for r in rows if r.source_type == "hackernews"]
    assert stories.max_per_feed == 15 and stories.keywords == list(DEFAULT_STORY_KEYWORDS)


def test_selection(registry):
    assert parse_source_ids(" two, rss ,,two") == ["two", "rss"]
    assert _ids(select_sources(registry)) == ["one", "two", "text", "trend", "stories", "odd"]
    assert _ids(select_sources(registry, ["two", "rss"])) == ["two", "one", "text"]
    assert _ids(select_sources(registry, ["HN", "github"])) == ["stories", "trend"]
    for missing in ("off", "nothing"):
        with pytest.raises(ValueError, match=missing):
            select_sources(registry, ["one", missing])


RSS = """<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<item><title>A &amp;amp; B</title><link> https://X.com/a </link><guid isPermaLink="false">g1</guid>
<pubDate>Mon, 01 Jan 2024 08:30:00 GMT</pubDate><description>short</description>
<content:encoded><![CDATA[<p>full &amp; text</p>]]></content:encoded></item>
<item><title>Yesterday</title><link>https://x.com/b</link><pubDate>Sun, 31 Dec 2023 23:59:59 GMT</pubDate></item>
<item><title>By link</title><guid>https://x.com/issues/24-01-01-x</guid><description>d</description></item>
<item><title> </title><link>https://x.com/c</link><pubDate>Mon, 01 Jan 2024 08:30:00 GMT</pubDate></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom</title>
<link href="https://y.com/self" rel="self"/><link href="https://y.com/1" rel="alternate"/><id>urn:1</id>
<updated>2024-01-01T03:04:05Z</updated><summary>sum</summary><content type="html">body</content></entry></feed>"""
PAGE = """<article class="Box-row"><h2><a href="/owner / repo "> owner / repo </a></h2><p>First <b>para</b></p>
<p>second</p><a href="/owner/repo/stargazers"><svg></svg>1,234</a>
<span class="d-inline-block float-sm-right">56 stars today</span></article>
<article class="Box-row"><h2>no anchor</h2></article><article class="other"><h2><a href="/n/o">x</a></h2></article>
<article class="Box-row extra"><h2><a href="/a/b"><br>t</a></h2></article>"""


def _story(id_, **fields):
    return (DAY, id_, json.dumps({"id": id_, "type": "story", "time": 1704100000, **fields}))


STORIES = [
    _story(1, title="AI &amp; more", url="https://z.com/1", score=7, descendants=3, text="<p>t"),
    _story(2, title="other"),
    _story(3, title="said", url=None, text=None),
    _story(4, title="ai yesterday", time=1704000000),
    (DAY, 5, json.dumps({"type": "job", "title": "ai", "time": 1704100000})),
    (DAY, 6, None),
    (DAY, 7, "null"),
]


def _landed(spark, *changes):
    rows = {
        ("one", "u1"): RSS, ("one", "u2"): ATOM, ("two", "u3"): "no feed at all",
        ("trend", "python"): PAGE, ("trend", "cpp"): "<html></html>",
        ("stories", "top"): "[3, 9]", ("stories", "best"): "[1]", ("stories", "new"): "[1, 2]",
    }
    for source, part, value in changes:
        rows[source, part] = value
    return spark.createDataFrame(
        [
            (DAY, s, p, "failed" if v is None else "ok", "boom" if v is None else None, v, NOON)
            for (s, p), v in rows.items()
        ],
        LANDED,
    )


def _collected(spark, registry, *changes):
    found = collect(
        _landed(spark, *changes), spark.createDataFrame(STORIES, LANDED_STORY), select_sources(registry)
    )
    return found.items.orderBy("ord").collect(), {r.source_config_id: r.message for r in found.warnings.collect()}


def test_all_sources_in_registry_order(spark, registry):
    items, warnings = _collected(spark, registry)
    assert [(i.source_config_id, i.title) for i in items] == [
        ("one", "A & B"), ("one", "By link"), ("one", "Atom"),
        ("trend", "owner/repo"), ("trend", "a/b"), ("stories", "said"), ("stories", "AI & more"),
    ]
    assert warnings == {
        "odd": "odd failed: unsupported source type: carrier-pigeon",
        "two": "two failed: u3: body is no feed",
    }
    first, linked, atom, repo, bare, said, story = items
    assert (first.source, first.source_name, first.source_id, first.url) == ("rss", "x.com", "g1", "https://X.com/a")
    assert (first.published_at, first.summary) == ("2024-01-01T08:30:00Z", "<p>full & text</p>")
    assert (linked.url, linked.published_at) == ("https://x.com/issues/24-01-01-x", "2024-01-01T00:00:00Z")
    assert (atom.url, atom.source_id, atom.summary) == ("https://y.com/1", "urn:1", "body")
    assert (repo.source, repo.source_type, repo.url) == ("github", "github_trending", "https://github.com/owner/repo")
    assert (repo.summary, repo.published_at) == ("First para", "2024-01-01T12:00:00Z")
    assert repo.raw_popularity.asDict() == {
        "stars_total": 1234, "stars_today": 56, "language": "python", "hn_score": None, "hn_comments": None,
    }
    assert (bare.summary, bare.raw_popularity.stars_total) == ("", 0)
    assert (story.source, story.source_name, story.source_id) == ("hn", "news.ycombinator.com", "1")
    assert (story.summary, story.raw_popularity.hn_score, story.raw_popularity.hn_comments) == ("<p>t", 7, 3)
    assert said.url == "https://news.ycombinator.com/item?id=3"


def test_failed_feed_url_is_skipped_while_others_give_items(spark, registry):
    items, warnings = _collected(spark, registry, ("one", "u1", None), ("two", "u3", None))
    assert [i.title for i in items if i.source_config_id == "one"] == ["Atom"]
    assert warnings["two"] == "two failed: u3: boom" and "one" not in warnings


def test_one_failed_language_loses_the_trending_source(spark, registry):
    items, warnings = _collected(spark, registry, ("trend", "cpp", None))
    assert not [i for i in items if i.source == "github"]
    assert warnings["trend"] == "trend failed: boom"


def test_one_failed_list_loses_the_story_source(spark, registry):
    items, warnings = _collected(spark, registry, ("stories", "best", None))
    assert not [i for i in items if i.source == "hn"]
    assert warnings["stories"] == "stories failed: boom"


def test_unknown_list_loses_the_story_source(spark):
    doc = {"sources": [{"id": "s", "type": "hackernews", "params": {"feeds": ["top", "ask"]}}]}
    registry = parse_registry(spark.createDataFrame([(json.dumps(doc),)], "doc string"))
    landed = spark.createDataFrame(
        [(DAY, "s", "top", "ok", None, "[1]", NOON)], LANDED  # no lander can fetch the other
    )
    found = collect(landed, spark.createDataFrame(STORIES, LANDED_STORY), registry)
    assert found.items.count() == 0
    assert [w.message for w in found.warnings.collect()] == ["s failed: unsupported list: ask"]


def test_late_snapshots_do_not_count_and_do_not_fail(spark, registry):
    landed = _landed(spark, ("trend", "cpp", None)).replace("x", "x").selectExpr(
        "run_date", "source_config_id", "part", "status", "error", "body",
        "fetched_at + interval 1 day as fetched_at",
    )
    found = collect(landed, spark.createDataFrame(STORIES, LANDED_STORY), select_sources(registry, ["trend"]))
    assert found.items.count() == 0 and found.warnings.count() == 0


def test_lists_merge_in_order_without_repeats(spark):
    lists = spark.createDataFrame(
        [("d", 0, [1, 2, 3], 2), ("d", 1, [3, 4], 2), ("d", 2, [1, 4, 5], 2)],
        "run string, part_pos int, ids array<bigint>, max_per_feed int",
    )
    merged = merge_lists(lists, ["run"]).orderBy("ord").collect()
    assert [r.id for r in merged] == [1, 2, 3, 4]


def test_parts_are_numbered(registry):
    parts = source_parts(registry).filter("source_config_id = 'one'").orderBy("part_pos").collect()
    assert [(p.part_pos, p.part) for p in parts] == [(0, "u1"), (1, "u2")]


ENTRY = "<entry><title{0}>{1}</title><link href='http://h/{2}'/><updated>2024-01-01T10:00Z</updated>{3}</entry>"


@pytest.mark.parametrize("body, expected", [
    ("<rss><channel><title>A & B</title><item><title>Tom & Jerry&nbsp;x</title><link>http://h/1?a=1&b=2</link></item></channel></rss>",
     [("Tom & Jerry x", "http://h/1?a=1&b=2", "")]),
    ("<rss><channel><item><title>one\x01</title><link>http://h/1</link></item><item><title>cut of",
     [("one", "http://h/1", "")]),
    ("<feed>" + ENTRY.format(" type='xhtml'", "<div>Big <b>news</b></div>", 1, "<summary>plain</summary>") + "</feed>",
     [("<div>Big <b>news</b></div>", "http://h/1", "plain")]),
    ("<feed>" + ENTRY.format("", "t", 1, "<content type='html'><![CDATA[<p>a & b</p>]]></content>") + "<entry><title>x",
     [("t", "http://h/1", "<p>a & b</p>")]),
    ("<rss><channel><item><title>t</title><link>http://h/1</link><description>a <p>b</p></description></item></channel></rss>",
     [("t", "http://h/1", "a <p>b</p>")]),
    ("<rss><channel><item><title>t</title><link>http://h/1</link><description>first</description>"
     "<description>second</description></item></channel></rss>", [("t", "http://h/1", "second")]),
])
def test_damaged_feeds_are_mended(spark, body, expected):
    landed = spark.createDataFrame([(1, body)], "k int, body string")
    rows = feeds.entry_items(feeds.parse_entries(landed)).collect()
    assert [(r["title"], r["url"], r["summary"]) for r in rows] == expected


def test_bodies_that_are_no_feed_are_found(spark):
    bodies = ["<html>down</html>", "{}", "<rss><channel><title>t</title></channel></rss>", "<feed/>", None,
              "<rss><channel><item><title>t</title></item></channel></rss>", "<rss><channel><item></rss"]
    landed = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    assert sorted(r["k"] for r in feeds.unreadable_feeds(landed).collect()) == [0, 1, 6]


def test_unreadable_lists_and_payloads_lose_the_story_source(spark, registry):
    items, warnings = _collected(spark, registry, ("stories", "new", "<oops"))
    assert "stories" not in {i.source_config_id for i in items}
    assert warnings["stories"] == "stories failed: body is no list"
    bad = [(DAY, 3, "{broken"), *(s for s in STORIES if s[1] != 3), (DAY, 99, "{not listed")]
    found = collect(_landed(spark), spark.createDataFrame(bad, LANDED_STORY), select_sources(registry))
    assert "stories" not in {r.source_config_id for r in found.items.collect()}
    messages = {r.source_config_id: r.message for r in found.warnings.collect()}
    assert messages["stories"] == "stories failed: story 3: payload is no JSON"


def test_an_attempt_without_status_failed(spark, registry):
    landed = _landed(spark).withColumn("status", F.when(F.col("part") != "u3", F.col("status")))
    found = collect(landed, spark.createDataFrame(STORIES, LANDED_STORY), select_sources(registry))
    assert {r.source_config_id: r.message for r in found.warnings.collect()}["two"] == "two failed: u3: no status"


def test_params_that_are_no_object_abort(spark):
    doc = '{"sources": [{"id": "a", "type": "rss", "params": ["x"]}]}'
    with pytest.raises(Exception, match="params is no object"):
        parse_registry(spark.createDataFrame([(doc,)], "doc string")).collect()
