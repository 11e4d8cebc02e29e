"""References inside of documents, and links of feeds that name a base address."""

import pytest
from pyspark.sql import functions as F

from feedrank.functions.urls import resolved
from feedrank.sources.feeds import entry_items, parse_entries

BASE = "http://a/b/c/d;p?q"
# The examples of RFC 3986, 5.4: reference and address.
EXAMPLES = """
g:h g:h
g http://a/b/c/g
./g http://a/b/c/g
g/ http://a/b/c/g/
/g http://a/g
//g http://g
?y http://a/b/c/d;p?y
g?y http://a/b/c/g?y
#s http://a/b/c/d;p?q#s
g#s http://a/b/c/g#s
g?y#s http://a/b/c/g?y#s
;x http://a/b/c/;x
g;x http://a/b/c/g;x
g;x?y#s http://a/b/c/g;x?y#s
. http://a/b/c/
./ http://a/b/c/
.. http://a/b/
../ http://a/b/
../g http://a/b/g
../.. http://a/
../../ http://a/
../../g http://a/g
../../../g http://a/g
../../../../g http://a/g
/./g http://a/g
/../g http://a/g
g. http://a/b/c/g.
.g http://a/b/c/.g
g.. http://a/b/c/g..
..g http://a/b/c/..g
./../g http://a/b/g
./g/. http://a/b/c/g/
g/./h http://a/b/c/g/h
g/../h http://a/b/c/h
g;x=1/./y http://a/b/c/g;x=1/y
g;x=1/../y http://a/b/c/y
g?y/./x http://a/b/c/g?y/./x
g?y/../x http://a/b/c/g?y/../x
g#s/./x http://a/b/c/g#s/./x
g#s/../x http://a/b/c/g#s/../x
http:g http:g
"""


def test_references_are_resolved_by_the_standard(spark):
    pairs = [line.split(" ") for line in EXAMPLES.strip().splitlines()]
    rows = [(BASE, r, u) for r, u in pairs] + [
        (BASE, "", BASE), (BASE, None, None), (None, "g", "g"), ("", "../g", "../g"), ("b/c", "g", "g"), ("mailto:x", "g", "g"),
        ("http://a", "g", "http://a/g"), ("http://a?q", "?y", "http://a?y"), ("http://a?q", "", "http://a?q"),
        (BASE, "x//../y", "http://a/b/c/x/y"), (BASE, "?", "http://a/b/c/d;p?"), (BASE, "g\nh", "http://a/b/c/g\nh"),
        (BASE, "#s\nt", BASE + "#s\nt"), (None, None, None),
    ]
    found = spark.createDataFrame(rows, "base string, reference string, url string").select(
        "reference", "url", resolved(F.col("base"), F.col("reference")).alias("found"))
    assert [(r["reference"], r["found"]) for r in found.collect()] == [(r, u) for _, r, u in rows]


RSS = """<rss version="2.0" xml:base="{root}"><channel xml:base="{channel}">
<item xml:base="{item}"><title>One</title><link xml:base="{link}">{at}</link></item>
<item><title>Two</title><guid>p/2</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xml:base="https://site.example/news/"><entry><title>Three</title>
<id>3</id><link rel="self" href="no"/><link href="../three"/></entry><entry xml:base="sub/"><title>Four</title>
<link xml:base="x/y" href="four"/></entry></feed>"""


@pytest.mark.parametrize("bases, address, second", [
    ({"root": "https://site.example/", "channel": "news/", "item": "a/", "link": "b/"}, "https://site.example/news/a/b/g", "https://site.example/news/p/2"),
    ({"root": "", "channel": "https://site.example/x/y", "item": "", "link": ""}, "https://site.example/x/g", "https://site.example/x/p/2"),
    ({"root": "", "channel": "", "item": "https://site.example/i/", "link": ""}, "https://site.example/i/g", "p/2"),
    ({"root": "", "channel": "", "item": "", "link": ""}, "g", "p/2"),
])
def test_links_of_feeds_are_resolved(spark, bases, address, second):
    feeds = spark.createDataFrame([(RSS.format(at="g", **bases),)], "body string")
    items = entry_items(parse_entries(feeds)).orderBy("row_pos").collect()
    assert [r["url"] for r in items] == [address, second]
    assert [r["source_id"] for r in items] == [address, "p/2"]


def test_links_of_atom_feeds_are_resolved(spark):
    items = entry_items(parse_entries(spark.createDataFrame([(ATOM,)], "body string"))).orderBy("row_pos").collect()
    assert [(r["title"], r["url"]) for r in items] == [
        ("Three", "https://site.example/three"), ("Four", "https://site.example/news/sub/x/four")]
    assert [r["source_name"] for r in items] == ["site.example"] * 2
