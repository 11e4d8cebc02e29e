import datetime as dt
import random
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.errors import SparkRuntimeException

from feedrank.functions import urls
from feedrank.params import TRACKING_PARAMS

PIECES = [
    "http", "HTTPS", ":", "//", "/", "?", "#", "&", "=", "a", "B", "é", "%20", "%", "%e4", "%C3%A9",
    "+", "~", "*", "utm_x", "Ref", "from", "x.com", "U:p@", "[::1]", ":80", " ", "\t", "1", ".", "-", "中",
]
STARTS = ["http://", "https://Ex.com/", "HTTP://a/", "", "//", "mailto:", " ", "ftp://h?"]


def _canonical(url):
    parts = urlsplit(url.strip())
    if not parts.scheme or not parts.netloc:
        return url.strip()
    query = [
        (k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True)
        if not k.lower().startswith("utm_") and k.lower() not in TRACKING_PARAMS
    ]
    path = parts.path.rstrip("/") or "/"
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), path, urlencode(query), ""))


def test_canonical_url_and_domain_match_the_standard_library(column):
    rng = random.Random(5)
    values, expected, hosts = [], [], []
    for _ in range(6000):
        url = rng.choice(STARTS) + "".join(rng.choices(PIECES, k=rng.randint(0, 14)))
        try:
            expected.append(_canonical(url))
        except ValueError:
            continue
        values.append(url)
        hosts.append(urlsplit(url).netloc.lower())
    assert column(urls.canonicalize_url, values) == expected
    assert column(urls.url_domain, values) == hosts


@pytest.mark.parametrize(
    "raw, canonical",
    [
        ("HTTP://Ex.COM", "http://ex.com/"),
        ("https://u:P@H.com:80/A?b#f", "https://u:p@h.com:80/A?b="),
        ("https://x.com/a//?UTM_X=1&Ref=2&q=a%20b~*", "https://x.com/a?q=a+b~%2A"),
        (" foo ", "foo"),
        ("//x.com/a", "//x.com/a"),
        ("mailto:x@y", "mailto:x@y"),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_url_edge_cases(column, raw, canonical):
    assert column(urls.canonicalize_url, [raw]) == [canonical]


@pytest.mark.parametrize("raw", ["http://[::1/a", "http://::1]/a", "http://[zz]/"])
def test_malformed_ip_literal_aborts(column, raw):
    with pytest.raises(SparkRuntimeException, match="malformed URL"):
        column(urls.canonicalize_url, [raw])


def test_source_name(column):
    assert column(urls.source_name, ["https://A.com/x", "/x", "", None]) == ["a.com", "rss", "rss", "rss"]


@pytest.mark.parametrize(
    "link, date",
    [
        ("/issues/26-03-01-x", dt.date(2026, 3, 1)),
        ("/issues/2026-03-01-x", dt.date(2026, 3, 1)),
        ("/issues/26-02-30-x", None),
        ("/issues/26-02-30-/issues/2026-03-01-x", None),
        ("/x", None),
        (None, None),
    ],
)
def test_link_date(column, link, date):
    assert column(urls.link_date, [link]) == [date]
