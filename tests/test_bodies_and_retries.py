import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedrank.schemas import LANDED
from feedrank.sources.bodies import decoded, encoding_of, landed_from_files, read_bodies
from feedrank.sources.landing import settled

DAY, NEXT = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
TEXT = "Ñandú – 智能编码 é"


def xml(name, text=TEXT):
    return f"<?xml version='1.0' encoding=\"{name}\"?><rss>{text}</rss>"


@pytest.mark.parametrize("body, header, charset, text", [
    (TEXT.encode(), None, "UTF-8", TEXT),
    (b"\xef\xbb\xbf" + TEXT.encode(), "text/xml; charset=gbk", "UTF-8", TEXT),
    (b"\xff\xfe" + TEXT.encode("utf-16-le"), None, "UTF-16LE", TEXT),
    (b"\xfe\xff" + TEXT.encode("utf-16-be"), "charset=utf-8", "UTF-16BE", TEXT),
    (xml("utf-16").encode("utf-16-le"), None, "UTF-16LE", xml("utf-16")),
    (xml("utf-16").encode("utf-16-be"), None, "UTF-16BE", xml("utf-16")),
    (xml("utf-16").encode(), None, "UTF-8", xml("utf-16")),  # the declaration can't be true
    (xml("GB2312").encode("gb18030"), "text/xml; charset=iso-8859-1", "GB18030", xml("GB2312")),
    (TEXT.encode("gb18030"), 'text/xml; Charset="GBK"', "GB18030", TEXT),
    (xml("ISO-8859-1", "é’").encode("cp1252"), None, "windows-1252", xml("ISO-8859-1", "é’")),
    ("caf\xe9".encode("latin-1"), None, "windows-1252", "café"),
    (xml("nonsense").encode(), "charset=nothing", "UTF-8", xml("nonsense")),
    (xml("utf-8", "x").encode() + b"\xff\xfey", None, "UTF-8", None),
    (b"", None, "UTF-8", ""),
    (None, "charset=gbk", None, None),
])
def test_encodings(spark, body, header, charset, text):
    rows = spark.createDataFrame([(body, header)], "b binary, h string")
    row = rows.select(encoding_of(F.col("b"), F.col("h")).alias("e"), decoded(F.col("b"), F.col("h")).alias("t")).first()
    assert row["e"] == charset
    assert row["t"] == text if text is not None or body is None else "�" in row["t"]


def test_files_are_read_by_date(spark, tmp_path):
    for date, name, body in ((DAY, "a%2F1.xml", TEXT.encode("gb18030")), (DAY, "b+.xml", b"\xff\xfe" + "x".encode("utf-16-le")), (NEXT, "a%2F1.xml", b"other")):
        folder = tmp_path / f"run_date={date}"
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(body)
    files = read_bodies(spark, str(tmp_path), [DAY])
    assert "PartitionFilters: [isnotnull(run_date" in files._jdf.queryExecution().executedPlan().toString()
    log = spark.createDataFrame(
        [(DAY, "s", "p", "ok", None, None, "a/1.xml", "charset=gb2312"), (DAY, "s", "q", "ok", None, None, "b+.xml", None),
         (DAY, "s", "r", "ok", None, None, "gone.xml", None), (DAY, "s", "t", "failed", "HTTP 503", None, None, None)],
        "run_date date, source_config_id string, part string, status string, error string, fetched_at timestamp, file string, content_type string")
    landed = landed_from_files(log, files).orderBy("part")
    assert set(landed.columns) == {c.split(" ")[0] for c in LANDED.split(", ")}
    assert [(r["part"], r["status"], r["error"], r["body"]) for r in landed.collect()] == [
        ("p", "ok", None, TEXT), ("q", "ok", None, "x"), ("r", "failed", "no body", None), ("t", "failed", "HTTP 503", None)]
    assert read_bodies(spark, str(tmp_path), []).count() == 0 and read_bodies(spark, str(tmp_path)).count() == 3


def test_several_attempts_settle_to_one(spark):
    def at(hour, day=1):
        return dt.datetime(2024, 1, day, hour)

    rows = [
        (DAY, "s", "once", "failed", "a", None, at(1)),
        (DAY, "s", "later ok", "failed", "a", None, at(1)), (DAY, "s", "later ok", "ok", None, "x", at(2)), (DAY, "s", "later ok", "ok", None, "y", at(3)),
        (DAY, "s", "never", "failed", "a", None, at(1)), (DAY, "s", "never", None, "b", None, at(2)),
        (DAY, "s", "early", "ok", None, "old", dt.datetime(2023, 12, 31, 23)), (DAY, "s", "early", "ok", None, "new", at(5)),
        (DAY, "s", "late", "ok", None, "late", at(5, 2)), (DAY, "s", "late", "failed", "a", None, at(5)),
        (NEXT, "s", "later ok", "ok", None, "z", at(1, 2)), (DAY, None, "p", "ok", None, "u", None), (DAY, None, "p", "ok", None, "u", None),
    ]
    landed = spark.createDataFrame(rows, LANDED).repartition(3)
    found = sorted((str(r["run_date"]), r["part"], r["status"], r["error"], r["body"]) for r in settled(landed).collect())
    assert settled(landed).columns == landed.columns
    assert found == sorted([
        ("2024-01-01", "once", "failed", "a", None), ("2024-01-01", "later ok", "ok", None, "x"), ("2024-01-01", "never", None, "b", None),
        ("2024-01-01", "early", "ok", None, "new"), ("2024-01-01", "late", "ok", None, "late"), ("2024-01-02", "later ok", "ok", None, "z"),
        ("2024-01-01", "p", "ok", None, "u")], key=str)
    single = spark.createDataFrame(rows[:1], LANDED)
    assert settled(single) is single
