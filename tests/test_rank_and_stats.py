import datetime as dt

from pyspark.sql import functions as F

from feedrank.functions import times
from feedrank.operators import rank
from feedrank.operators.keywords import keyword_hits
from feedrank.operators.rank import select_candidates, top_n
from feedrank.operators.stats import run_stats, source_counts
from feedrank.params import Params

NOW = times.as_timestamp
DAY = dt.date(2024, 1, 1)
SCHEMA = "run_date date, ord bigint, score double, published_at string, source_config_id string"


def _items(spark, rows):
    return spark.createDataFrame([(DAY, i, s, p, "a") for i, s, p in rows], SCHEMA)


def test_ties_prefer_the_older_item_then_input_order(spark):
    items = _items(spark, [
        (0, 50.0, "2024-01-01T09:00:00Z"),
        (1, 50.0, "2024-01-01T08:00:00Z"),
        (2, 60.0, "2024-01-01T10:00:00Z"),
        (3, 50.0, "2024-01-01T08:00:00Z"),
        (4, None, ""),
    ])
    now = times.as_timestamp("2024-02-01T00:00:00Z")
    for by in (("run_date",), ()):
        best = top_n(items, 4, now, by).orderBy("rank").collect()
        assert [(r["rank"], r["ord"]) for r in best] == [(1, 2), (2, 1), (3, 3), (4, 0)]
    assert top_n(items, -1, now).count() == 0
    assert top_n(items, -1, now, ()).count() == 0


def test_any_n_gives_the_plain_ranking(spark):
    items = _items(spark, [(i, float(i % 7), "2024-01-01T00:00:00Z") for i in range(200)])
    now = times.as_timestamp("2024-02-01T00:00:00Z")
    plain = sorted(range(200), key=lambda i: (-(i % 7), i))
    for n in (1, 50, 2000):
        assert [r["ord"] for r in top_n(items, n, now).orderBy("rank").collect()] == plain[:n]


def test_group_limit_and_top_k_are_in_the_plans(spark):
    items = _items(spark, [(0, 1.0, "2024-01-01T00:00:00Z")])
    now = times.as_timestamp("2024-02-01T00:00:00Z")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert plan(top_n(items, 10, now)).count("WindowGroupLimit") >= 2  # before and after the shuffle
    assert "TakeOrderedAndProject" in plan(top_n(items, 10, now, ()))


def test_threshold_is_inclusive(spark):
    items = _items(spark, [(0, 45.0, ""), (1, 44.99, ""), (2, None, "")])
    assert [r.ord for r in select_candidates(items, 45.0).collect()] == [0]


def test_stats_count_fetched_items_and_empty_dates(spark):
    raw = spark.createDataFrame(
        [(DAY, i, 0.0, "", s) for i, s in enumerate("aab")], SCHEMA
    )
    kept = _items(spark, [(0, 50.0, ""), (1, 40.0, "")])
    dates = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(1),)], "run_date date")
    now = times.as_timestamp("2024-02-01T00:00:00Z")
    stats = run_stats(raw, kept, 45.0, 10, now, dates).orderBy("run_date").collect()
    counts = [(r.total_fetched, r.after_dedup, r.above_threshold, r.top_n) for r in stats]
    assert counts == [(3, 2, 1, 1), (0, 0, 0, 0)]
    assert {(r.threshold, r.generated_at) for r in stats} == {(45.0, "2024-02-01T00:00:00Z")}
    assert run_stats(raw, kept, 45.0, -3, now).first().top_n == 0
    assert {(r.source_config_id, r.fetched) for r in source_counts(raw).collect()} == {("a", 2), ("b", 1)}


def test_keyword_hits_are_rows(spark):
    rows = spark.createDataFrame([(1, "Use CURSOR and cline"), (2, "none")], "id int, t string")
    hits = keyword_hits(rows, F.col("t"), Params()).orderBy("keyword").collect()
    assert [(h.id, h.keyword_group, h.keyword, h.weight) for h in hits] == [
        (1, "tools", "cline", 4.0), (1, "tools", "cursor", 4.0),
    ]
