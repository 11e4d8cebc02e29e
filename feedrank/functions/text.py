"""Text cleaning: entity unescaping, Unicode folding, whitespace, truncation, digits.

Everything runs as built-in expressions except NFKC, which Spark lacks. That goes through Arrow,
together with unescaping, and only for values that can change: every other row sends a null to Python.
"""

from __future__ import annotations

import functools
import html
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedrank.functions.computed import once
from feedrank.functions.entities import unescaped

# What Python's str.isspace() accepts besides U+0020, below and above U+0100.
_LOW_SPACE = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x{85}\x{A0}"
_HIGH_SPACE = r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE = f"[ {_LOW_SPACE}{_HIGH_SPACE}]"
TRAILING_WHITESPACE = rf"{_SPACE}+\z"
EDGE_WHITESPACE = rf"\A{_SPACE}+|{TRAILING_WHITESPACE}"

# Characters that unescaping or NFKC may change, alone or next to others. Left out are ASCII but
# "&", the Latin-1 letters, common dashes, quotes and bullets, and the CJK ideographs.
MAY_CHANGE = (
    r"[&\x{80}-\x{BF}\x{100}-\x{2012}\x{2017}\x{2024}-\x{4DFF}\x{A000}-\x{10FFFF}]"
)
CJK = r"[\x{4E00}-\x{9FFF}]"


def _each(values: pa.Array, fn) -> pa.Array:
    if values.null_count == len(values):
        return values
    return pa.array([None if v is None else fn(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _unescape_and_fold(values: pa.Array) -> pa.Array:
    return _each(values, lambda v: unicodedata.normalize("NFKC", html.unescape(v)))


def strip(col: Column) -> Column:
    """Trim every kind of whitespace, not only U+0020."""
    return F.regexp_replace(col, EDGE_WHITESPACE, "")


def _ascii(col: Column) -> Column:
    return F.octet_length(col) == F.char_length(col)


def collapse_whitespace(col: Column) -> Column:
    """Runs of whitespace become one space; none is left at the ends.

    Three narrow patterns, the first for non-ASCII text only, are several times faster than
    one that names all kinds of whitespace.
    """
    narrow = F.when(_ascii(col), col).otherwise(
        F.regexp_replace(col, rf"[\x{{1680}}-\x{{3000}}&&[{_HIGH_SPACE}]]", " ")
    )
    spaced = F.regexp_replace(narrow, f"[{_LOW_SPACE}]", " ")
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def normalize_title(col: Column) -> Column:
    """Unescape one level, fold to NFKC, collapse whitespace; null becomes empty."""
    may_change = F.contains(col, F.lit("&")) | (~_ascii(col) & col.rlike(MAY_CHANGE))
    folded = _unescape_and_fold(F.when(may_change, col))
    return collapse_whitespace(F.coalesce(folded, col, F.lit("")))


def clean_text(col: Column, max_len: int = 800) -> Column:
    """Unescape one level, collapse whitespace; longer text is cut and ends in "..."."""
    plain = F.when(F.contains(col, F.lit("&")), unescaped(col)).otherwise(F.coalesce(col, F.lit("")))
    return once(plain, lambda text: _collapsed(text, max_len))


def _collapsed(text: Column, max_len: int) -> Column:
    """`text` collapsed and truncated. If its beginning alone comes to more than `max_len`, so does the whole, and what is
    behind it is cut off anyway; else the whole is collapsed."""
    begins = F.when(F.octet_length(text) > 2 * max_len, collapse_whitespace(F.substring(text, 1, 2 * max_len)))
    return once(begins, lambda begin: F.when(F.char_length(begin) > max_len, truncate(begin, max_len)).otherwise(
        once(collapse_whitespace(text), lambda whole: truncate(whole, max_len))))


def truncate(col: Column, max_len: int) -> Column:
    """Keep up to `max_len` code points; longer text loses its tail to "..."."""
    cut = F.concat(F.rtrim(F.substring(col, 1, max_len - 1)), F.lit("..."))
    return F.when(F.char_length(col) <= max_len, col).otherwise(cut)


def first_non_empty(*cols: Column) -> Column:
    """The first value that is neither null nor empty, else null."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def has_cjk(col: Column) -> Column:
    return col.rlike(CJK)


@functools.cache
def _decimal_digits() -> tuple[str, str]:
    """All non-ASCII decimal digits and, aligned with them, their ASCII values."""
    digits = [
        chr(cp) for cp in range(128, sys.maxunicode + 1) if unicodedata.category(chr(cp)) == "Nd"
    ]
    return "".join(digits), "".join(str(unicodedata.digit(d)) for d in digits)


def digits_to_int(col: Column) -> Column:
    """All decimal digits of the text read as one number; 0 if there is none. A number that no long
    holds becomes the largest long, so that it still counts as very popular."""
    found = F.regexp_replace(F.translate(col, *_decimal_digits()), "[^0-9]", "")
    number = F.nullif(found, F.lit(""))
    largest = F.when(number.isNotNull(), F.lit(2**63 - 1))
    return F.coalesce(number.try_cast("bigint"), largest, F.lit(0))
