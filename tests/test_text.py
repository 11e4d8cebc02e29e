import html
import random
import re
import sys
import unicodedata

import pytest

from feedrank.functions import text

PIECES = list("aB &;#<>éß\u00a0\u3000ＡｂﬁǺ\x1f\t\nｶﾞ中文。，…“”") + [
    "&amp;", "&nbsp;", "&copy", "&#65;", "&amp;amp;", "e\u0301",
]


def _random_texts(n=2000, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(n)]


def _normalized(value):
    folded = unicodedata.normalize("NFKC", html.unescape(value or ""))
    return re.sub(r"\s+", " ", folded).strip()


def _cleaned(value, limit):
    flat = re.sub(r"\s+", " ", html.unescape(value or "")).strip()
    return flat if len(flat) <= limit else flat[: limit - 1].rstrip() + "..."


def test_normalize_title_matches_the_standard_library(column):
    values = _random_texts() + [None, "", " A&nbsp;&amp;amp;  Ｂ "]
    assert column(text.normalize_title, values) == [_normalized(v) for v in values]
    assert column(text.normalize_title, [values[-1]]) == ["A &amp; B"]


def test_clean_text_matches_the_standard_library(column):
    values = _random_texts(seed=4) + [None, "x" * 801, "ab  cd  ef"]
    for limit in (5, 800):
        assert column(lambda c: text.clean_text(c, limit), values) == [_cleaned(v, limit) for v in values]
    assert column(text.clean_text, ["x" * 801]) == ["x" * 799 + "..."]


def test_whitespace_class_is_that_of_python(column):
    values = [f"a{chr(cp)}{chr(cp)}b" for cp in range(1, 0x3100) if not 0xD800 <= cp < 0xE000]
    assert column(text.collapse_whitespace, values) == [re.sub(r"\s+", " ", v) for v in values]
    edges = [f"{chr(cp)}a {chr(cp)}" for cp in range(1, 0x3100)]
    assert column(text.strip, edges) == [v.strip() for v in edges]


def test_characters_that_skip_python_are_left_alone_by_nfkc():
    may_change = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), text.MAY_CHANGE))
    skipped = [chr(cp) for cp in range(sys.maxunicode + 1)
               if not 0xD800 <= cp < 0xE000 and not may_change.match(chr(cp))]
    assert len(skipped) > 20000
    for char in skipped:
        assert unicodedata.normalize("NFKC", char) == char, hex(ord(char))
        assert unicodedata.combining(char) == 0, hex(ord(char))
        assert unicodedata.normalize("NFKC", "e" + char) == "e" + char, hex(ord(char))


@pytest.mark.parametrize(
    "raw, number", [("1,234", 1234), ("1.2k", 12), ("", 0), (None, 0), ("１２٣ stars", 123), ("none", 0)]
)
def test_digits_to_int(column, raw, number):
    assert column(text.digits_to_int, [raw]) == [number]


def test_digits_beyond_a_long(column):
    assert column(text.digits_to_int, ["9" * 25, "9223372036854775807", "9223372036854775808"]) == [2**63 - 1] * 3
