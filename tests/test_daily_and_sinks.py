import datetime as dt
import json
import re
import subprocess
import sys
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from conftest import SMALL
from feedrank.functions import times
from feedrank.operators.enrich import enrich, with_identity
from feedrank.operators.rank import select_candidates
from feedrank.params import Params
from feedrank.plans.daily import daily_run, for_dates, run_job
from feedrank.schemas import LANDED, LANDED_STORY, RAW_ITEM
from feedrank.session import release, scope, stored
from feedrank.sinks import published
from feedrank.sinks.raw import OUTPUTS, read_raw, run_header, write_raw
from feedrank.sinks.report import preview, report_files

DAY, NEXT = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
NOW = "2024-01-02T00:00:00Z"

REPORT = """# AI 资讯 Top 2 - 2024-01-01

- 抓取总数: 4
- 去重后数量: 2
- 阈值以上数量: 2
- 分数阈值: 45.0

## 1. Cursor & MCP
- 来源: RSS
- 分数: 56.0
- 发布时间: 2024-01-01T10:00:00Z
- 标签: cursor, mcp
- 链接: https://x.com/a?utm_source=f
- 摘要: （原文为英文，未做机器翻译）

## 2. plain
- 来源: RSS
- 分数: 49.0
- 发布时间: 2024-01-02T00:00:00Z
- 标签: -
- 链接: https://x.com/b
"""
EMPTY = """# AI 资讯 Top 0 - 2024-01-02

- 抓取总数: 1
- 去重后数量: 1
- 阈值以上数量: 0
- 分数阈值: 45.0

该日期暂无满足阈值条件的资讯。"""


def _item(day, ord_, title, url, published="2024-01-01T10:00:00Z", summary="", source="rss"):
    return (day, ord_, source, "x.com", None, title, url, published, summary, None, "s", "rss")


@pytest.fixture(scope="module")
def run(spark):
    items = spark.createDataFrame(
        [
            _item(DAY, 0, " Cursor &amp; MCP ", "https://x.com/a?utm_source=f", summary="some text"),
            _item(DAY, 1, "again", "https://X.com/a/"),
            _item(DAY, 2, "plain", "https://x.com/b", published=""),
            _item(DAY, 3, " ", "https://x.com/c"),
            _item(NEXT, 0, "low", "https://x.com/a", source="blog"),
        ],
        RAW_ITEM,
    )
    return daily_run(items, times.as_timestamp(NOW))


def _single(folder: Path, date: str, suffix: str) -> str:
    (file,) = folder.glob(f"version=*/run_date={date}/*.{suffix}")
    return file.read_text()


def test_reports(run, tmp_path):
    documents = {r.run_date: r.document for r in run.reports.collect()}
    assert documents == {DAY: REPORT, NEXT: EMPTY}
    published.publish({"reports": report_files(run.reports)}, run.reports, str(tmp_path))
    assert _single(tmp_path / "reports", "2024-01-01", "txt") == REPORT
    assert _single(tmp_path / "reports", "2024-01-02", "txt") == EMPTY + "\n"
    read = published.read_published(run.reports.sparkSession, str(tmp_path), "reports", report_files(run.reports).schema)
    assert {r["run_date"]: r["value"] for r in read.collect()} == {DAY: REPORT, NEXT: EMPTY + "\n"}


def test_preview(run):
    rows = preview(run.top).orderBy("rank").collect()
    assert [(r.rank, r.score, r.title, r.url) for r in rows] == [
        (1, 56.0, "Cursor & MCP", "https://x.com/a?utm_source=f"), (2, 49.0, "plain", "https://x.com/b"),
    ]


def test_raw_output_round_trip(spark, run, tmp_path):
    write_raw(run.deduped, run_header(run.stats, "sources.json", ["s"]), str(tmp_path))
    items = published.read_published(spark, str(tmp_path), "items", run.deduped.schema)
    assert sorted(items.select(sorted(items.columns)).collect()) == sorted(
        run.deduped.select(sorted(items.columns)).collect()
    )
    line = json.loads(_single(tmp_path / "items", "2024-01-02", "json"))
    assert line["raw_popularity"] is None and line["tags"] == [] and line["score"] == 25.0
    header = json.loads(_single(tmp_path / "runs", "2024-01-02", "json"))
    assert header == {
        "stats": {"total_fetched": 1, "after_dedup": 1, "above_threshold": 0, "top_n": 0,
                  "threshold": 45.0, "generated_at": NOW},
        "run_meta": {"config_path": "sources.json", "selected_sources": ["s"], "source_count": 1},
    }


def _read(spark, path, run, header):
    rows = read_raw(spark, str(path), run.deduped.schema, header.schema).collect()
    return sorted((str(r["run_date"]), r["ord"], r["title"], r["total_fetched"], r["top_n"]) for r in rows)


def test_rewriting_a_date_leaves_the_others(spark, run, tmp_path):
    header = run_header(run.stats, None, [])
    write_raw(run.deduped, header, str(tmp_path))
    before = _read(spark, tmp_path, run, header)
    assert {row[0] for row in before} == {"2024-01-01", "2024-01-02"}
    changed = run.deduped.filter("run_date = '2024-01-02'").withColumn("title", F.lit("new"))
    write_raw(changed, header.filter("run_date = '2024-01-02'"), str(tmp_path))
    after = _read(spark, tmp_path, run, header)
    assert [row for row in after if row[0] == "2024-01-01"] == [row for row in before if row[0] == "2024-01-01"]
    assert {row[2] for row in after if row[0] == "2024-01-02"} == {"new"}


def test_a_date_published_again_without_items_has_none(spark, run, tmp_path):
    header = run_header(run.stats, None, [])
    write_raw(run.deduped, header, str(tmp_path))
    write_raw(run.deduped.limit(0), header, str(tmp_path))
    assert _read(spark, tmp_path, run, header) == []
    assert published.read_published(spark, str(tmp_path), "runs", header.schema).count() == 2


def test_a_run_that_breaks_off_leaves_every_date_whole(spark, run, tmp_path, monkeypatch):
    header = run_header(run.stats, None, [])
    write_raw(run.deduped, header, str(tmp_path), run.reports)
    before = _read(spark, tmp_path, run, header)
    items = run.deduped.withColumn("title", F.lit("new"))
    broken = header.withColumn("run_date", F.when(F.col("run_date") > "2024-01-01", F.raise_error(F.lit("lost")).cast("date")).otherwise(F.col("run_date")))
    with pytest.raises(Exception, match="lost"):
        write_raw(items, broken, str(tmp_path))  # items are written, headers are not
    assert len(list((tmp_path / "items").glob("version=*"))) == 2
    assert _read(spark, tmp_path, run, header) == before
    with monkeypatch.context() as patch:  # all is written but the manifest
        patch.setattr(published, "MANIFEST", "nowhere/\0")
        with pytest.raises(Exception):
            write_raw(items, header, str(tmp_path), run.reports)
    assert _read(spark, tmp_path, run, header) == before
    write_raw(items, header, str(tmp_path), run.reports)
    assert {row[2] for row in _read(spark, tmp_path, run, header)} == {"new"}


def test_a_killed_driver_leaves_every_date_whole(spark, run, tmp_path):
    """A process that ends between two writes, without any handler."""
    header = run_header(run.stats, None, [])
    write_raw(run.deduped, header, str(tmp_path))
    before = _read(spark, tmp_path, run, header)
    script = f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from feedrank.sinks import published
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
items = spark.sql("SELECT DATE'2024-01-01' AS run_date, 'half' AS title")
class Ends(dict):
    def items(self):
        yield "items", items
        os._exit(9)
published.publish(Ends(), items, {str(tmp_path)!r})
"""
    ended = subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=300)
    assert ended.returncode == 9 and len(list((tmp_path / "items").glob("version=*"))) == 2
    assert _read(spark, tmp_path, run, header) == before


def test_other_versions_are_not_read_and_can_be_cleaned(spark, run, tmp_path):
    header = run_header(run.stats, None, [])
    first = write_raw(run.deduped, header, str(tmp_path))
    second = write_raw(run.deduped, header.filter("run_date = '2024-01-02'"), str(tmp_path))
    current = {str(r["run_date"]): r["version"] for r in published.current(spark, str(tmp_path)).collect()}
    assert current == {"2024-01-01": first, "2024-01-02": second}
    assert published.clean(spark, str(tmp_path), OUTPUTS) == []
    before = _read(spark, tmp_path, run, header)
    third = write_raw(run.deduped, header, str(tmp_path))
    assert sorted(published.clean(spark, str(tmp_path), OUTPUTS)) == sorted([first, second])
    assert [p.name for p in (tmp_path / "items").glob("version=*")] == [f"version={third}"]
    assert _read(spark, tmp_path, run, header) == before


def test_jobs_side_by_side_keep_their_tables(spark):
    """Each thread releases its own stored tables only."""
    both = threading.Barrier(2)

    def job(rows, first):
        with scope(spark):
            table = stored(spark.range(rows), "own")
            both.wait(60)
            if first:
                release(spark)
            both.wait(60)
            return None if first else table.count()

    with ThreadPoolExecutor(2) as pool:
        first, second = pool.submit(job, 5, True), pool.submit(job, 20, False)
        assert (first.result(), second.result()) == (None, 20)
    queries = driver.queries()
    with ThreadPoolExecutor(2) as pool:
        counts = [pool.submit(lambda name=name: queries[name](spark, SMALL).count()) for name in ("dedup_hot_key", "dedup_braid")]
        assert all(c.result() > 0 for c in counts)


def test_malformed_time_aborts_even_on_a_duplicate(spark):
    items = spark.createDataFrame(
        [_item(DAY, 0, "a", "https://x.com/a"), _item(DAY, 1, "b", "https://x.com/a", published="soon")],
        RAW_ITEM,
    )
    with pytest.raises(Exception, match="soon"):
        daily_run(items, times.as_timestamp(NOW)).deduped.collect()


def test_dedup_comes_before_the_threshold(spark):
    """A low-scoring first copy removes a better one, and then falls below the threshold."""
    items = spark.createDataFrame(
        [_item(DAY, 0, "a", "https://x.com/a", source="blog"), _item(DAY, 1, "b", "https://x.com/a")],
        RAW_ITEM,
    )
    run = daily_run(items, times.as_timestamp(NOW), Params(top_n=5))
    assert run.deduped.count() == 1 and run.top.count() == 0


def test_job_from_landed_fetches_to_files(spark, tmp_path):
    registry = tmp_path / "sources.json"
    registry.write_text(json.dumps({"sources": [
        {"id": "f", "type": "rss", "params": {"urls": ["u"]}}, {"id": "g", "type": "rss", "params": {"urls": ["v"]}},
    ]}))
    feed = ("<rss><channel><item><title>Copilot news</title><link>https://x.com/1</link>"
            "<pubDate>Mon, 01 Jan 2024 08:30:00 GMT</pubDate></item></channel></rss>")
    landed = spark.createDataFrame(
        [(DAY, "f", "u", "ok", None, feed, None), (NEXT, "f", "u", "failed", "boom", None, None)], LANDED
    )
    stories = spark.createDataFrame([], LANDED_STORY)
    out = str(tmp_path / "out")
    warnings = run_job(spark, str(registry), landed, stories, out, NOW, sources="rss")
    assert [(w.run_date, w.message) for w in warnings.collect()] == [(NEXT, "f failed: u: boom")]
    assert "## 1. Copilot news" in _single(tmp_path / "out/reports", "2024-01-01", "txt")
    assert "Top 0 - 2024-01-02" in _single(tmp_path / "out/reports", "2024-01-02", "txt")
    header = json.loads(_single(tmp_path / "out/runs", "2024-01-01", "json"))
    assert header["run_meta"]["selected_sources"] == ["f", "g"]


def test_text_is_cleaned_once_per_row(spark):
    """No definition is copied into pushed-down filters or into other expressions."""
    items = spark.createDataFrame([_item(DAY, 0, "a", "https://x.com/a")], RAW_ITEM)
    best = select_candidates(enrich(items, times.as_timestamp(NOW)), 45.0)
    plan = best._jdf.queryExecution().executedPlan().toString()
    evaluations = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert sum(line.count("_unescape_and_fold(") for line in evaluations) == 2
    assert 0 < plan.count("Contains(_text") <= 27


def test_a_date_reaches_the_scan(spark, tmp_path):
    items = spark.createDataFrame([("2024-01-01", 1, "t", "http://h/1", None), ("2024-01-02", 2, "u", "http://h/2", None)],
                                  "run_date string, ord long, title string, url string, source_id string")
    path = str(tmp_path / "items")
    items.withColumn("run_date", F.col("run_date").cast("date")).write.partitionBy("run_date").parquet(path)
    chosen = with_identity(for_dates(spark.read.parquet(path), ["2024-01-02"]), Params())
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*2024-01-02", plan) or re.search(r"PartitionFilters: \[[^\]]*19724", plan)
    assert [r["ord"] for r in chosen.collect()] == [2]
    assert for_dates(items, []).count() == 0 and for_dates(items, None).count() == 2
