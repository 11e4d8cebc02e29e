import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from feedrank.functions import text
from feedrank.schemas import LANDED
from feedrank.session import stored
from feedrank.sources.feeds import mended, parse_entries
from feedrank.sources.landing import settled
from feedrank.sources.registry import parse_registry, source_parts
from feedrank.sources.stories import read_stories, scan_stories, unreadable_payloads
from feedrank.sources.trending import scan_trending

DAY = dt.date(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """No join is broadcast for its size, as if every table were large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def parts(spark):
    doc = ('{"sources": [{"id": "t", "type": "github_trending"}, '
           '{"id": "s", "type": "hackernews", "params": {"require_keyword_match": false}}]}')
    return source_parts(parse_registry(spark.createDataFrame([(doc,)], "doc string")))


def test_bodies_are_not_dealt_by_part_or_source(shuffled, parts):
    landed = shuffled.createDataFrame([], LANDED)
    stories = shuffled.createDataFrame([], "run_date date, id bigint, body string")
    for scan in (scan_trending(landed, parts), scan_stories(landed, stories, parts)):
        assert "hashpartitioning(source_config_id" not in _plan(scan)


def test_a_settled_fetch_is_read_not_derived_by_every_scan(spark):
    rows = [(DAY, "s", "p", "failed", "a", None, None), (DAY, "s", "p", "ok", None, "x", dt.datetime(2024, 1, 1, 2))]
    found = settled(spark.createDataFrame(rows, LANDED))
    assert "Exchange" not in _plan(found) and [r["body"] for r in found.collect()] == ["x"]


def test_a_body_is_mended_once(spark):
    feeds = stored(spark.createDataFrame([(1, "<rss></rss>")], "id int, body string"), "feeds")
    assert parse_entries(feeds)._jdf.queryExecution().optimizedPlan().toString().count("description|summary|content:encoded") == 1


@pytest.mark.parametrize("body, expected", [
    ("<rss>a\x0bb￾c￿\U0001f600\t\r\n</rss>", "<rss>abc\U0001f600\t\r\n</rss>"),
    ("<rss>￿</rss>", "<rss></rss>"), ("<rss>￾</rss>", "<rss></rss>"), ("<rss>\x1f</rss>", "<rss></rss>"),
    ("<rss><title>a<b>c</b></title></rss>", "<rss><title><![CDATA[a<b>c</b>]]></title></rss>"),
    ("<rss><item></item><item>x &", "<rss><item></item></channel></rss>"),
])
def test_mended_bodies(column, body, expected):
    assert column(mended, [body, None]) == [expected, None]


def test_long_texts_are_cleaned_as_a_whole(column):
    rng = random.Random(5)
    values = ["".join(rng.choices(["a", "é", " ", "\n", " " * 9, "　", "&amp;", "\U0001f600"], k=rng.randint(5, 90))) for _ in range(400)]
    values += [" " * 50 + "a" * n for n in (9, 10, 11, 30)] + ["a" * n + " " * 50 + "b" for n in (8, 9, 10, 11)]
    for limit in (10, 20):
        flat = [" ".join(v.replace("&amp;", "&").split()) for v in values]
        assert column(lambda c: text.clean_text(c, limit), values) == [
            v if len(v) <= limit else v[: limit - 1].rstrip() + "..." for v in flat]


def test_unreadable_payloads_are_told_next_to_the_items(shuffled, parts):
    midnight = dt.datetime(2024, 1, 1)
    landed = shuffled.createDataFrame([(DAY, "s", "top", "ok", None, "[3, 2, 1, 9]", midnight)], LANDED)
    good = '{"id": 1, "type": "story", "title": "T", "time": 1704067200}'
    bodies = [(1, good), (2, "{no"), (3, '{"type": "job"}'), (9, ""), (4, "{not listed"), (5, None)]
    stories = shuffled.createDataFrame([(DAY, i, b) for i, b in bodies], "run_date date, id bigint, body string")
    read = read_stories(landed, stories, parts)
    assert sorted((r["source_id"], r["unreadable"]) for r in read.collect()) == [("1", False), ("2", True), ("9", True)]
    assert read.filter("NOT unreadable").drop("unreadable").collect() == scan_stories(landed, stories, parts).collect()
    assert [tuple(r) for r in unreadable_payloads(read).collect()] == [(DAY, "s", "story 2: payload is no JSON")]
