"""URL handling as built-in expressions: splitting, canonical form, host, dates in links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedrank.functions.text import strip
from feedrank.params import TRACKING_PARAMS, TRACKING_PREFIXES

# Pieces of a URL. An authority runs up to the path, the query or the fragment.
_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_ROOT = rf"^({_SCHEME}//[^/?#]+)"
_AUTHORITY = rf"^(?:{_SCHEME})?//([^/?#]*)"
_PATH = rf"{_ROOT}([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"

# Brackets in an authority must enclose an IP literal; anything else is malformed.
_IP_LITERAL = (
    r"[^\[/?#]*\[(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\]/?#]*)?|v[0-9A-Fa-f]+\.[^\]/?#]+)\]"
)
_MALFORMED = rf"^(?:{_SCHEME})?//(?!{_IP_LITERAL})[^/?#]*[\[\]]"

_STRAY_PERCENT = "%(?![0-9A-Fa-f]{2})"


def _parseable(url: Column) -> Column:
    """Drop what URL parsers ignore: leading control characters, tabs, line breaks."""
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


def _decode(text: Column) -> Column:
    """Form-style decoding; a "%" that starts no escape stands for itself."""
    return F.url_decode(F.regexp_replace(text, _STRAY_PERCENT, "%25"))


def _encode(text: Column) -> Column:
    """Form-style encoding that leaves only letters, digits and "_.-~" as they are."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column, prefixes: Sequence[str], names: Sequence[str]) -> Column:
    """Re-encoded query without tracking parameters, in its original order."""

    def wanted(pair: Column) -> Column:
        name = F.lower(_decode(F.substring_index(pair, "=", 1)))
        tracking = name.isin(list(names))
        for prefix in prefixes:
            tracking = tracking | F.startswith(name, F.lit(prefix))
        return (pair != "") & ~tracking

    def encoded(pair: Column) -> Column:
        name = F.substring_index(pair, "=", 1)
        value = F.substring(pair, F.char_length(name) + 2, F.char_length(pair))
        return F.concat(_encode(_decode(name)), F.lit("="), _encode(_decode(value)))

    return F.array_join(F.transform(F.filter(F.split(query, "&"), wanted), encoded), "&")


def canonicalize_url(
    url: Column,
    tracking_prefixes: Sequence[str] = TRACKING_PREFIXES,
    tracking_params: Sequence[str] = TRACKING_PARAMS,
) -> Column:
    """Comparable form of a URL: lower-case scheme and authority, no trailing slash, no
    fragment, no tracking parameters. Text that is not an absolute URL is only trimmed; a
    malformed IP literal aborts the job."""
    stripped = strip(F.coalesce(url, F.lit("")))
    uri = _parseable(stripped)
    path = F.rtrim(F.regexp_extract(uri, _PATH, 2), F.lit("/"))
    query = _clean_query(F.regexp_extract(uri, _QUERY, 1), tracking_prefixes, tracking_params)
    absolute = F.concat(
        F.lower(F.regexp_extract(uri, _ROOT, 1)),
        F.coalesce(F.nullif(path, F.lit("")), F.lit("/")),
        F.rtrim(F.concat(F.lit("?"), query), F.lit("?")),  # in a query, "?" is encoded
    )
    malformed = F.raise_error(F.concat(F.lit("malformed URL: "), stripped)).cast("string")
    return (
        F.when(uri.rlike(_MALFORMED), malformed)
        .when(uri.rlike(_ROOT), absolute)
        .otherwise(stripped)
    )


def _split(url: Column) -> Column:
    """The pieces of a reference, each with its delimiter; one that is not there is empty."""
    return F.struct(
        F.regexp_extract(url, rf"^({_SCHEME})", 1).alias("scheme"),
        F.regexp_extract(url, rf"^(?:{_SCHEME})?(//[^/?#]*)", 1).alias("authority"),
        F.regexp_extract(url, rf"^(?:{_SCHEME})?(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
        F.regexp_extract(url, r"(?s)^[^#]*(#.*)", 1).alias("fragment"),
    )


def _without_dots(path: Column) -> Column:
    """An absolute path without "." and ".." segments, as a fold over its segments; other paths stay as they are."""

    def step(kept: Column, segment: Column) -> Column:
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == ".", kept).when(segment == "..", shorter).otherwise(F.array_append(kept, segment))

    kept = F.aggregate(F.split(F.substr(path, F.lit(2)), "/", -1), F.array().cast("array<string>"), step)
    ended = F.when(path.rlike(r"/\.\.?\z"), F.array_append(kept, F.lit(""))).otherwise(kept)
    dotted = F.startswith(path, F.lit("/")) & path.rlike(r"/\.\.?(?:/|\z)")
    return F.when(dotted, F.concat(F.lit("/"), F.array_join(ended, "/"))).otherwise(path)


def resolved(base: Column, reference: Column) -> Column:
    """The address that a reference means in a document at `base`, by the strict rules of RFC 3986 (5.2). Where the base has no
    scheme and authority, or is null, the reference stays as it is; a null reference is null."""

    def joined(both: Column) -> Column:
        b, r = both["base"], both["reference"]
        whole = (r["scheme"] != "") | (r["authority"] != "")
        folder = F.regexp_extract(b["path"], r"(?s)^(.*/)", 1)
        merged = F.concat(F.when(b["path"] == "", F.lit("/")).otherwise(folder), r["path"])
        path = F.when(whole | F.startswith(r["path"], F.lit("/")), r["path"]).otherwise(merged)
        same = ~whole & (r["path"] == "")
        return F.concat(
            F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]),
            F.when(whole, r["authority"]).otherwise(b["authority"]),
            F.when(same, b["path"]).otherwise(_without_dots(path)),
            F.when(same & (r["query"] == ""), b["query"]).otherwise(r["query"]),
            r["fragment"],
        )

    both = F.struct(_split(base).alias("base"), _split(reference).alias("reference"))
    return F.when(base.rlike(_ROOT), F.transform(F.array(both), joined)[0]).otherwise(reference)


def inner_base(outer: Column, own: Column) -> Column:
    """The base address inside of an element that may have one of its own."""
    return F.coalesce(resolved(outer, own), outer)


def url_domain(url: Column) -> Column:
    """Lower-cased authority of a URL, empty if it has none."""
    return F.lower(F.regexp_extract(_parseable(F.coalesce(url, F.lit(""))), _AUTHORITY, 1))


def source_name(link: Column) -> Column:
    """Name of the feed source behind a link."""
    return F.coalesce(F.nullif(url_domain(link), F.lit("")), F.lit("rss"))


def link_date(link: Column) -> Column:
    """Date in a link such as `/issues/24-01-31-title`; the short form is tried first."""
    short, long = r"/issues/([0-9]{2}-[0-9]{2}-[0-9]{2})-", r"/issues/([0-9]{4}-[0-9]{2}-[0-9]{2})-"
    return F.when(
        link.rlike(short),
        F.try_to_date(F.concat(F.lit("20"), F.regexp_extract(link, short, 1)), "yyyy-MM-dd"),
    ).when(link.rlike(long), F.try_to_date(F.regexp_extract(link, long, 1), "yyyy-MM-dd"))
