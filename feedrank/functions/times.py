"""UTC timestamps: ISO text, feed dates, run dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedrank.functions.urls import link_date

# RFC 822 zone names and their offsets (fixed values).
ZONE_OFFSETS = {
    "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

RELATIVE_DAYS = {"today": 0, "yesterday": 1, "day-before": 2}

# day, month name, year, hour, minute, second, zone; the weekday is optional.
_MAIL_DATE = (
    r"^\s*(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{4}|\d{2})"
    r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([A-Za-z]+|[+-]\d{4}|[+-]\d{2}:\d{2})?\s*(?:\(.*\))?\s*$"
)
# date, time, seconds, fraction (what is beyond microseconds is cut off), zone
_W3C_DATE = (
    r"^\s*(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2})(?::(\d{2})(?:\.(\d{1,6})\d*)?)?\s*([Zz]|[+-]\d{2}:?\d{2})?)?\s*$"
)
# Extended or basic date; hour, minute, second; fraction; zone.
_ISO_TEXT = (
    r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))"
    r"(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?([Zz]|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def as_timestamp(value: dt.datetime | str | Column) -> Column:
    """A fixed "now": an aware or naive-UTC datetime, ISO text, or a column."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.timezone.utc)
        value = value.isoformat()
    return (F.lit(value) if isinstance(value, str) else value).cast("timestamp")


def iso_utc(ts: Column) -> Column:
    """Whole seconds, `2024-01-31T00:00:00Z`."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column, now: Column) -> Column:
    """ISO text, extended or basic, to timestamp; empty or null means `now`; any other text aborts the job."""

    def part(group: int, default: str = "00") -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(given, _ISO_TEXT, group), F.lit("")), F.lit(default))

    given = F.nullif(text, F.lit(""))
    zone = F.regexp_replace(F.upper(part(10, "Z")), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    zone = F.regexp_replace(zone, ":$", ":00")
    iso = F.concat(
        part(1), F.lit("-"), part(2, ""), part(4, ""), F.lit("-"), part(3, ""), part(5, ""), F.lit("T"),
        part(6), F.lit(":"), part(7), F.lit(":"), part(8), F.lit("."), part(9), zone)
    malformed = F.raise_error(F.concat(F.lit("malformed time: "), given)).cast("timestamp")
    parsed = F.when(given.rlike(_ISO_TEXT), iso.cast("timestamp")).otherwise(malformed)
    return F.when(given.isNull(), now).otherwise(parsed)


def _zone_offset(zone: Column) -> Column:
    """Offset as +hh:mm; no zone or an unknown name means UTC."""
    names = F.create_map(*(F.lit(v) for pair in ZONE_OFFSETS.items() for v in pair))
    return F.when(
        zone.rlike(r"^[+-]"), F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    ).otherwise(F.coalesce(F.try_element_at(names, F.upper(zone)), F.lit("+00:00")))


def parse_mail_date(text: Column) -> Column:
    """RFC 822 / 2822 date to timestamp, null if the text is none."""

    def part(group: int) -> Column:
        return F.regexp_extract(text, _MAIL_DATE, group)

    months = F.create_map(*(F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, f"{i:02d}")))
    # A two-digit year is one of 1969 to 2068.
    year = F.regexp_replace(
        F.regexp_replace(part(3), r"^([0-5]\d|6[0-8])$", "20$1"), r"^(\d{2})$", "19$1"
    )
    iso = F.concat(
        year, F.lit("-"), F.try_element_at(months, F.lower(part(2))), F.lit("-"), part(1),
        F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), F.lpad(part(6), 2, "0"),
        _zone_offset(part(7)),
    )
    return F.when(text.rlike(_MAIL_DATE), iso.try_cast("timestamp"))


def parse_w3c_date(text: Column) -> Column:
    """ISO 8601 / W3C date, with or without time and zone; null if the text is none."""

    def part(group: int, default: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, _W3C_DATE, group), F.lit("")), F.lit(default))

    zone = F.regexp_replace(F.upper(part(5, "Z")), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    iso = F.concat(part(1, ""), F.lit("T"), part(2, "00:00"), F.lit(":"), part(3, "00"), F.lit("."), part(4, "0"), zone)
    return F.when(text.rlike(_W3C_DATE), iso.try_cast("timestamp"))


def entry_timestamp(published: Column, updated: Column, link: Column) -> Column:
    """When a feed entry was published: its own dates first, else the date in its link."""
    return F.coalesce(
        parse_mail_date(published), parse_w3c_date(published),
        parse_mail_date(updated), parse_w3c_date(updated),
        link_date(link).cast("timestamp"),
    )


def run_date(relative: str = "yesterday", explicit: dt.date | str | None = None,
             as_of: dt.date | None = None) -> dt.date:
    """The date a run covers: the given one, or today / yesterday / day-before (UTC)."""
    if explicit:
        return explicit if isinstance(explicit, dt.date) else dt.date.fromisoformat(explicit)
    today = as_of or dt.datetime.now(dt.timezone.utc).date()
    return today - dt.timedelta(days=RELATIVE_DAYS[relative])


def on_date(ts: Column, day: Column) -> Column:
    """Does the timestamp fall on that UTC date? A range, so that scans can skip by it."""
    return (ts >= day) & (ts < F.date_add(day, 1))
