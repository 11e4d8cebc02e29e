import random

import pytest
from pyspark.sql import functions as F

from feedrank.functions import scoring, times
from feedrank.params import GROUP_WEIGHTS, KEYWORD_GROUPS, Params

DEFAULTS = Params()


def test_rounding_is_that_of_python(column):
    rng = random.Random(6)
    values = [rng.uniform(-200, 200) for _ in range(20000)] + [rng.uniform(-1, 1) for _ in range(20000)]
    values += [i / 1000 for i in range(-5000, 100000, 5)] + [rng.randint(0, 20000) * 0.005 for _ in range(5000)]
    values += [0.125, 0.375, 2.675, 0.005, 1.005, -0.0, 1e-9, 54.125, 0.0625, 2.0**-60]
    assert column(scoring.round_cents, values, "double") == [round(v, 2) for v in values]


def _keywords(column, text):
    points = column(lambda c: scoring.keyword_score(F.lower(c), DEFAULTS), [text])[0]
    tags = column(lambda c: scoring.keyword_tags(F.lower(c), DEFAULTS), [text])[0]
    return points, tags


def test_keywords_are_substrings(column):
    assert _keywords(column, "Recursor discontinued") == (8.0, ["continue", "cursor"])
    assert _keywords(column, "nothing") == (0.0, [])
    assert _keywords(column, "AI编程 with MCP") == (7.0, ["ai编程", "mcp"])


def test_no_keyword_spans_title_and_summary(column):
    text = column(lambda c: scoring.keyword_text(c, F.lit("Review")), ["Code"])[0]
    assert _keywords(column, text) == (0.0, [])


def test_keyword_points_are_capped(column):
    words = [k for group in KEYWORD_GROUPS.values() for k in group]
    points, tags = _keywords(column, " ; ".join(words))
    assert points == 25.0
    assert tags == sorted(words) and len(tags) == 27
    assert sum(GROUP_WEIGHTS[g] * len(ks) for g, ks in KEYWORD_GROUPS.items()) > 25


@pytest.mark.parametrize(
    "source, numbers, points",
    [
        ("github", "600, 0, 0, 0", 20.0),
        ("github", "10, 250, 0, 0", 10 / 25.0 + 250 / 50000.0),
        ("github", "null, null, null, null", 0.0),
        ("github", "-100, 0, 0, 0", -4.0),
        ("hn", "9, 9, 12, 25", 2.0),
        ("rss", "600, 600, 600, 600", 0.0),
        ("GitHub", "600, 0, 0, 0", 0.0),
    ],
)
def test_popularity(spark, source, numbers, points):
    today, total, votes, comments = numbers.split(", ")
    struct = F.expr(
        f"struct({today} as stars_today, {total} as stars_total, {votes} as hn_score, {comments} as hn_comments)"
    )
    row = spark.range(1).select(struct.alias("n")).select(
        scoring.popularity_score(F.lit(source), F.col("n"), DEFAULTS).alias("p")
    )
    assert row.first().p == points


@pytest.mark.parametrize(
    "seconds, points",
    [(86400, 15.0), (86401, 12.0), (-18000, 15.0), (48 * 3600, 12.0), (72 * 3600, 10.0),
     (168 * 3600, 6.0), (720 * 3600, 3.0), (721 * 3600, 1.0)],
)
def test_freshness_bounds_are_inclusive(spark, seconds, points):
    now = times.as_timestamp("2024-01-31T00:00:00Z")
    then = F.timestamp_seconds(F.unix_seconds(now) - seconds)
    assert spark.range(1).select(scoring.freshness_score(then, now).alias("p")).first().p == points


def test_weights_and_labels(column):
    sources = ["rss", "github", "hn", "RSS", "", None, "blog"]
    assert column(lambda c: scoring.source_weight(c, DEFAULTS), sources) == [34, 28, 24, 10, 10, 10, 10]
    assert column(lambda c: scoring.source_label(c, DEFAULTS), sources) == [
        "RSS", "GitHub", "Hacker News", "RSS", "-", "-", "blog",
    ]


def test_overridden_weights(column):
    mine = Params(source_weights={"rss": 1.5}, keyword_groups={"x": ("a",)}, group_weights={"x": 2.25})
    assert column(lambda c: scoring.source_weight(c, mine), ["rss", "hn"]) == [1.5, 10.0]
    assert column(lambda c: scoring.keyword_score(c, mine), ["abc", "b"]) == [2.25, 0.0]


def test_summary_line(column):
    assert column(scoring.summary_line, ["", "only ascii", "有 CJK"]) == [None, scoring.NOT_TRANSLATED, "有 CJK"]
