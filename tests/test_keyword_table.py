import random

import pytest
from pyspark.sql import functions as F

from feedrank.operators import keyword_table as kt
from feedrank.operators.keyword_table import table_hits, table_points
from feedrank.operators.keywords import keyword_hits
from feedrank.params import Params

KEYWORDS = "keyword_group string, keyword string, weight double"


def hits(spark, texts, keywords):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    found = table_hits(rows, F.col("text"), spark.createDataFrame(keywords, KEYWORDS), ["id"])
    assert found.columns == ["id", "keyword_group", "keyword", "weight"]
    return found


def plain(texts, keywords):
    return sorted((i, *k) for i, t in enumerate(texts) for k in set(keywords) if t is not None and k[1] and k[1].lower() in t.lower())


def rows(found):
    return sorted(tuple(r) for r in found.collect())


def text_of(rng, n, letters="abcdé日 \n"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_keywords_of_all_lengths(spark):
    rng = random.Random(4)
    texts = [text_of(rng, rng.choice([0, 1, 3, 4, 31, 32, 33, 200, 1500])) for _ in range(120)] + [None, "", "AbCd", "ab" * 400]
    keywords = []
    for _ in range(150):
        source, n = rng.choice(texts) or "zzzz", rng.choice([1, 2, 3, 4, 5, 8, 31, 32, 33, 64, 65, 100, 300])
        at = rng.randint(0, len(source))
        keywords.append((rng.choice("xy"), source[at : at + n].upper(), float(n % 7)))
    keywords += [("x", "ab" * 33, 1.0), ("x", "ab" * 33 + "a", 1.0), ("x", "not there", 1.0), ("y", None, 1.0), ("y", "", 1.0), *keywords[:5]]
    keywords += [("y", k, w) for _, k, w in keywords[:20]] + [("x", (texts[-1][:70] + "c"), 2.0)]
    expected = plain(texts, keywords)
    assert rows(hits(spark, texts, keywords)) == expected and len(expected) > 1000


def test_the_built_in_keywords_give_the_same_rows(spark):
    texts = ["Use CURSOR and cline", "none", "AI编程 with MCP", "agentic coding; code review? refactor!", "Recursor discontinued"]
    params = Params()
    keywords = [(g, k, params.group_weights[g]) for g, own in params.keyword_groups.items() for k in own]
    source = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    expected = keyword_hits(source, F.col("text"), params).select("id", "keyword_group", "keyword", "weight")
    found = hits(spark, texts, keywords)
    assert rows(found) == rows(expected)
    points = {r["id"]: r["points"] for r in table_points(found, ["id"], 25.0).collect()}
    assert points == {0: 8.0, 2: 7.0, 3: 11.0, 4: 8.0}


def test_no_texts_and_no_keywords(spark):
    assert rows(hits(spark, ["a", None], [])) == []
    assert rows(hits(spark, [None, ""], [("x", "a", 1.0)])) == []
    empty = spark.createDataFrame([], "id int, text string")
    assert table_hits(empty, F.col("text"), spark.createDataFrame([("x", "a", 1.0)], KEYWORDS), ["id"]).count() == 0


def test_texts_longer_than_a_step(spark, monkeypatch):
    monkeypatch.setattr(kt, "_STEP", 64)
    rng = random.Random(6)
    texts = [text_of(rng, n) for n in (10, 500, 63, 64, 65, 1, 0, 700)]
    keywords = [("x", t[i : i + n], 1.0) for t in texts for i in range(0, len(t), 37) for n in (2, 6, 40)]
    assert rows(hits(spark, texts, keywords)) == plain(texts, keywords)


def test_a_hundred_thousand_keywords(spark):
    rng = random.Random(8)
    keywords = list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(5, 9))) for _ in range(100_000)})
    texts = [" ".join(rng.choices(keywords, k=40)) for _ in range(300)]
    found = hits(spark, texts, [("x", k, 1.0) for k in keywords])
    known = set(keywords)
    expected = sorted(
        (i, k) for i, t in enumerate(texts) for k in known & {t[a : a + n] for n in range(5, 10) for a in range(len(t) - n + 1)})
    assert sorted((r["id"], r["keyword"]) for r in found.collect()) == expected


def test_no_pairs_are_made_and_nothing_is_broadcast_by_hand(spark):
    found = hits(spark, ["abcdef"], [("x", "cdef", 1.0)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "ResolvedHint" not in plan and "strategy=broadcast" not in plan


def test_points_are_summed_exactly(spark):
    found = spark.createDataFrame([(1, 0.1)] * 10 + [(2, 99.5)], "id int, weight double")
    assert {r["id"]: r["points"] for r in table_points(found, ["id"], 25.0).collect()} == {1: 1.0, 2: 25.0}


@pytest.mark.parametrize("bits", [6, 12])
def test_a_full_filter_loses_nothing(spark, monkeypatch, bits):
    whole = kt.bitmap
    monkeypatch.setattr(kt, "bitmap", lambda hashes, column: whole(hashes, column, bits))
    rng = random.Random(bits)
    texts = [text_of(rng, 120) for _ in range(20)]
    keywords = [("x", t[i : i + 9], 1.0) for t in texts for i in range(0, 100, 9)]
    assert rows(hits(spark, texts, keywords)) == plain(texts, keywords)
