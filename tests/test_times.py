import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from feedrank.functions import times

NOW = times.as_timestamp


@pytest.mark.parametrize(
    "published, expected",
    [
        ("Mon, 01 Jan 2024 08:30:00 GMT", "2024-01-01T08:30:00Z"),
        ("1 Feb 24 08:30 EST", "2024-02-01T13:30:00Z"),
        ("1 Feb 99 08:30:05", "1999-02-01T08:30:05Z"),
        ("Tue, 02 Jan 2024 08:30:07 +0530", "2024-01-02T03:00:07Z"),
        ("Thu, 5 Jun 2025 9:05:59 -07:00 (PDT)", "2025-06-05T16:05:59Z"),
        ("2024-01-02T03:04:05z", "2024-01-02T03:04:05Z"),
        ("2024-01-02T03:04:05.5+0100", "2024-01-02T02:04:05Z"),
        ("2024-01-02", "2024-01-02T00:00:00Z"),
        ("garbage", "2024-03-01T00:00:00Z"),
        (None, "2024-03-01T00:00:00Z"),
    ],
)
def test_entry_timestamp(column, published, expected):
    link = F.lit("https://x/issues/24-03-01-a")
    found = column(
        lambda c: times.iso_utc(times.entry_timestamp(c, F.lit(None).cast("string"), link)), [published]
    )
    assert found == [expected]


def test_iso_round_trip_and_defaults(column):
    values = ["2024-01-31T10:00:00Z", "2024-01-31T10:00:00.9+02:00", "2024-01-31 10:00:00", "", None]
    now = times.as_timestamp(dt.datetime(2024, 2, 1))
    assert column(lambda c: times.iso_utc(times.parse_iso(c, now)), values) == [
        "2024-01-31T10:00:00Z", "2024-01-31T08:00:00Z", "2024-01-31T10:00:00Z",
        "2024-02-01T00:00:00Z", "2024-02-01T00:00:00Z",
    ]


@pytest.mark.parametrize("text", ["soon", "2024", "2024-1-1", " 2024-01-01 ", "2024-13-01", "2024-01-31T", "2024-01-31T25:00"])
def test_malformed_iso_aborts(column, text):
    with pytest.raises(PySparkException):
        column(lambda c: times.parse_iso(c, times.as_timestamp("2024-02-01T00:00:00Z")), [text])


def test_iso_forms(column):
    values = ["20240131T000000", "2024-01-31", "20240131", "2024-01-31T10", "2024-01-31T10:29+0530",
              "2024-01-31T10:00:00.123456789-01", "2024-01-31t10:00Z"]
    now = times.as_timestamp("2024-02-01T00:00:00Z")
    found = column(lambda c: times.iso_utc(times.parse_iso(c, now)), values[:-1])
    assert found == ["2024-01-31T00:00:00Z", "2024-01-31T00:00:00Z", "2024-01-31T00:00:00Z", "2024-01-31T10:00:00Z",
                     "2024-01-31T04:59:00Z", "2024-01-31T11:00:00Z"]


def test_w3c_forms(column):
    values = ["2024-05-17T10:29Z", "2024-05-17T10:29+02:00", "2024-05-17T10:29:30.123456789Z", "2024-05-17t10:29z",
              "2024-05-17 10:29", "2024-05-17", "2024-05", "2024-05-17T10"]
    assert column(lambda c: times.iso_utc(times.parse_w3c_date(c)), values) == [
        "2024-05-17T10:29:00Z", "2024-05-17T08:29:00Z", "2024-05-17T10:29:30Z", "2024-05-17T10:29:00Z",
        "2024-05-17T10:29:00Z", "2024-05-17T00:00:00Z", None, None]


def test_run_date():
    day = dt.date(2024, 3, 1)
    assert times.run_date("today", as_of=day) == day
    assert times.run_date(as_of=day) == dt.date(2024, 2, 29)
    assert times.run_date("day-before", as_of=day) == dt.date(2024, 2, 28)
    assert times.run_date(explicit="2024-01-31") == dt.date(2024, 1, 31)
    with pytest.raises(ValueError):
        times.run_date(explicit="31.01.2024")
