"""Character references of HTML resolved by expressions, one level, as Python's `html.unescape` does."""

from __future__ import annotations

import re
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedrank.functions.computed import once

_REPLACEMENT = "�"
_NUMBER = r"\A#(?:[xX]0*([0-9a-fA-F]+)|0*([0-9]+));?"
_NAME = r"\A([^\t\n\f <&#;]{1,32};?)"
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "mdash;", "ndash;", "hellip;", "rsquo;")
_MOST_DIGITS = 10  # longer numbers are beyond Unicode once leading zeros are off


@cache
def _names() -> tuple[dict[str, str], str]:
    """The text of every name, with its semicolon if it needs one; and a pattern for the longest name that needs
    none at the beginning of a text."""
    without = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)
    return dict(html5), rf"\A({'|'.join(map(re.escape, without))})"


def _windows_1252() -> dict[int, str]:
    """What numbers mean that name a byte of that code page rather than a control character."""
    found = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    return {**found, 0: _REPLACEMENT, 0x0D: "\r"}


def _character(number: Column) -> Column:
    """The character of a number, or nothing for those that stand for none."""
    bytes_ = F.unhex(F.lpad(F.hex(number), 8, "0"))
    last = number.bitwiseAND(F.lit(0xFFFF))
    nothing = (
        number.between(0x1, 0x8) | (number == 0xB) | number.between(0xE, 0x1F) | number.between(0x7F, 0x9F)
        | number.between(0xFDD0, 0xFDEF) | last.isin(0xFFFE, 0xFFFF))
    special = F.lit(None).cast("string")
    for known, text in _windows_1252().items():
        special = F.when(number == known, F.lit(text)).otherwise(special)
    return (
        F.when((number <= 0x9F) & special.isNotNull(), special)
        .when(number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit(_REPLACEMENT))
        .when(nothing, F.lit("")).otherwise(F.decode(bytes_, "UTF-32")))


def _number(digits: Column) -> Column:
    """The number of hexadecimal digits after an x, or of decimal ones."""
    long = F.length(digits) > _MOST_DIGITS
    return F.when(long, F.lit(0x110000).cast("bigint")).when(
        F.startswith(digits, F.lit("x")), F.conv(F.substring(digits, 2, _MOST_DIGITS), 16, 10).cast("bigint")).otherwise(digits.cast("bigint"))


def _resolved(piece: Column) -> Column:
    """What stands behind an ampersand, with the reference it begins with put in place, or the ampersand before it."""
    names, legacy = _names()

    def behind(found: Column) -> Column:
        return F.substring(piece, F.char_length(found) + 1, F.char_length(piece))

    def named(name: Column) -> Column:
        common = F.lit(None).cast("string")  # spares most references the search in the map
        for known in _COMMON:
            common = F.when(name == known, F.lit(names[known])).otherwise(common)
        # One constant, which the optimizer turns into a map once.
        table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in names.items())), F.lit("\x02"), F.lit("\x01"))
        rare = F.when(F.endswith(name, F.lit(";")), F.try_element_at(table, name))
        shorter = once(F.regexp_extract(name, legacy, 1), lambda short: F.when(
            short != "", F.concat(F.try_element_at(table, short), behind(short))))
        return F.coalesce(once(F.coalesce(common, rare), lambda text: F.concat(text, behind(name))), shorter, F.concat(F.lit("&"), piece))

    numbered = once(
        once(F.concat(F.when(piece.rlike(r"\A#[xX]"), "x").otherwise(""), F.regexp_extract(piece, _NUMBER, 1), F.regexp_extract(piece, _NUMBER, 2)), _number),
        lambda number: F.concat(_character(number), F.regexp_replace(piece, _NUMBER, "")))
    return F.when(piece.rlike(_NUMBER), numbered).when(
        piece.rlike(_NAME), once(F.regexp_extract(piece, _NAME, 1), named)).otherwise(F.concat(F.lit("&"), piece))


def unescaped(text: Column) -> Column:
    """The text with its character references resolved; null stays null. Give it texts with an ampersand only."""
    pieces = F.split(text, "&")
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _resolved)
    return F.concat(F.get(pieces, 0), F.array_join(rest, ""))
