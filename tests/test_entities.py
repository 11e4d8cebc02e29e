import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from feedrank.functions.entities import unescaped
from feedrank.functions.text import clean_text


def same(column, texts):
    assert column(unescaped, texts) == [html.unescape(t) for t in texts]


def test_every_name(column):
    same(column, [t for n in html5 for t in (f"a&{n}b", f"&{n}", f"&{n.rstrip(';')}", f"&{n.rstrip(';')}x;")])


def test_numbers(column):
    numbers = [*range(0x180), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**12, 10**30, 0x1F600]
    same(column, [t for n in numbers for t in (f"x&#{n};y", f"&#{n}y", f"&#x{n:x};", f"&#X{n:X}g", f"&#000{n};&#x000{n:x}")])


def test_what_is_no_reference(column):
    texts = ["&&amp;", "&", "& b", "&;", "&#;", "&#x;", "&#xg", "a&amp", "&ampamp;", "&amp;lt;", "&notit;", "&notin;", "&no", "", "plain",
             "&" + "a" * 40 + ";", "&lt\n&gt\t", "&AMP;&am p;", "&#38;lt;", "&copy2024", "&é;&é&eacute;é"]
    rng = random.Random(3)
    parts = ["&", "#", "x", "amp", ";", "lt", "1", "3", "9", "a", "not", "in", " ", "\n", "copy", "é"]
    same(column, texts + ["".join(rng.choices(parts, k=12)) for _ in range(2000)])
    assert column(unescaped, [None]) == [None]


def test_cleaning_needs_no_python(spark):
    rows = spark.createDataFrame([("a &lt; b",), (None,)], "t string").select(clean_text(F.col("t")).alias("t"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["t"] for r in rows.collect()] == ["a < b", ""]
