"""Landed bodies as bytes: their encoding, and files read by run date.

The encoding of a body is told by its byte order mark, else by its XML declaration, else by the landed
content type; where none says so, it is UTF-8 if the bytes are that, and Windows-1252 if not. What a name stands for
is in ENCODINGS; other names count as none. Bytes that an encoding does not have become the replacement character.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedrank.functions.computed import once

# --- Fixed values: names of encodings in declarations, and what decodes them. ---

ENCODINGS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "windows-1252", "ascii": "windows-1252",
    "iso-8859-1": "windows-1252", "latin-1": "windows-1252", "latin1": "windows-1252", "windows-1252": "windows-1252",
    "cp1252": "windows-1252", "iso-8859-2": "ISO-8859-2", "iso-8859-15": "ISO-8859-15", "windows-1250": "windows-1250",
    "windows-1251": "windows-1251", "koi8-r": "KOI8-R", "gb2312": "GB18030", "gbk": "GB18030", "gb18030": "GB18030",
    "big5": "Big5", "shift_jis": "Shift_JIS", "euc-jp": "EUC-JP", "euc-kr": "EUC-KR", "utf-16": "UTF-16",
    "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
}
_MARKS = (("EFBBBF", "UTF-8", 3), ("FFFE", "UTF-16LE", 2), ("FEFF", "UTF-16BE", 2))
_UNMARKED = (("3C003F00", "UTF-16LE"), ("003C003F", "UTF-16BE"))

# --- End of fixed values. ------------------------------------------------------

_DECLARED = r"\A\s*<\?xml[^>]*?\bencoding\s*=\s*[\"']([A-Za-z0-9._\-]+)[\"']"
_CHARSET = r"(?i)\bcharset\s*=\s*[\"']?([A-Za-z0-9._\-]+)"


def _named(name: Column) -> Column:
    known = F.lit(None).cast("string")
    for alias, charset in ENCODINGS.items():
        known = F.when(F.lower(name) == alias, F.lit(charset)).otherwise(known)
    return known


def encoding_of(body: Column, content_type: Column) -> Column:
    """The charset of a body (binary); null for a null body."""
    start = F.hex(F.substring(body, 1, 4))
    mark = F.lit(None).cast("string")
    for bytes_, charset, _ in _MARKS:
        mark = F.when(F.startswith(start, F.lit(bytes_)), charset).otherwise(mark)
    for bytes_, charset in _UNMARKED:
        mark = F.when(start == bytes_, charset).otherwise(mark)
    head = F.decode(F.substring(body, 1, 400), "ISO-8859-1")
    declared = _named(F.regexp_extract(head, _DECLARED, 1))
    # A declaration that can be read byte by byte is not in an encoding of two bytes.
    declared = F.when(~F.startswith(declared, F.lit("UTF-16")), declared)
    valid = F.when(F.is_valid_utf8(body.cast("string")), "UTF-8").otherwise("windows-1252")
    return F.when(body.isNotNull(), F.coalesce(mark, declared, _named(F.regexp_extract(content_type, _CHARSET, 1)), valid))


def decoded(body: Column, content_type: Column) -> Column:
    """A body as text, without its byte order mark."""
    mark = F.lit(0)
    for bytes_, _, size in _MARKS:
        mark = F.when(F.startswith(F.hex(F.substring(body, 1, 3)), F.lit(bytes_)), size).otherwise(mark)
    rest = F.substring(body, mark + 1, F.length(body))

    def text(charset: Column) -> Column:
        found = F.lit(None).cast("string")
        for known in sorted(set(ENCODINGS.values())):
            found = F.when(charset == known, F.decode(rest, known)).otherwise(found)
        return found

    return once(encoding_of(body, content_type), text)


def read_bodies(spark: SparkSession, path: str, dates: Iterable[dt.date | str] | None = None) -> DataFrame:
    """(run_date, file, content) of the files under `path`/run_date=<date>/, of the given dates only."""
    files = spark.read.format("binaryFile").load(path)
    if dates is not None:
        wanted = [F.lit(str(date)).cast("date") for date in dates]
        files = files.filter(F.col("run_date").cast("date").isin(*wanted)) if wanted else files.limit(0)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.select(F.col("run_date").cast("date").alias("run_date"), name.alias("file"), "content")


def landed_from_files(log: DataFrame, bodies: DataFrame) -> DataFrame:
    """Landed fetches whose bodies are files: `log` has their columns but for the body, and the `file` and `content_type` of
    each; a fetch whose file is missing failed."""
    by = ["run_date", "file"]
    found = log.join(bodies, by, "left")
    missing = (F.col("status") == "ok") & F.col("content").isNull()
    columns = [c for c in log.columns if c not in ("file", "content_type", "status", "error", "fetched_at")]
    return found.select(
        *columns, F.when(missing, "failed").otherwise(F.col("status")).alias("status"),
        F.when(missing, "no body").otherwise(F.col("error")).alias("error"),
        decoded(F.col("content"), F.col("content_type")).alias("body"), "fetched_at")


def encoded(text: Column, charset: str) -> Column:
    """The bytes of a text, with a byte order mark where the charset needs one."""
    marks = [F.lit(bytes.fromhex(bytes_)) for bytes_, known, _ in _MARKS if known == charset and charset != "UTF-8"]
    return reduce(lambda a, b: F.concat(b, a), marks, F.encode(text, charset))
