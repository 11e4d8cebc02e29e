"""The Markdown report of each run date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.functions.scoring import source_label, summary_line, tag_line
from feedrank.functions.text import TRAILING_WHITESPACE, strip
from feedrank.params import Params

# --- Fixed values: the wording of the report. --------------------------------

TITLE = "# AI 资讯 Top %s - %s"
STATS = "- 抓取总数: %s\n- 去重后数量: %s\n- 阈值以上数量: %s\n- 分数阈值: %s"
NOTHING = "该日期暂无满足阈值条件的资讯。"
HEADING = "## %s. %s"
FIELDS = "- 来源: %s\n- 分数: %s\n- 发布时间: %s\n- 标签: %s\n- 链接: %s"
SUMMARY = "- 摘要: "

# --- End of fixed values. ----------------------------------------------------


def item_block(params: Params) -> Column:
    """The lines of one ranked item."""
    lines = F.format_string(
        HEADING + "\n" + FIELDS,
        "rank",
        "title",
        source_label(F.col("source"), params),
        F.col("score").cast("string"),
        "published_at",
        tag_line(F.col("tags")),
        F.coalesce("url", F.lit("None")),
    )
    return F.concat_ws(
        "\n", lines, F.concat(F.lit(SUMMARY), summary_line(strip(F.coalesce("summary", F.lit("")))))
    )


def report_blocks(top: DataFrame, params: Params = Params()) -> DataFrame:
    """(run_date, rank, block) of the ranked items."""
    return top.select("run_date", "rank", item_block(params).alias("block"))


def report_documents(top: DataFrame, stats: DataFrame, params: Params = Params()) -> DataFrame:
    """(run_date, document): one Markdown text per run date in `stats`.

    A document gathers no more blocks than the report's top-N.
    """
    blocks = F.array_sort(F.collect_list(F.struct("rank", "block")))
    bodies = (
        report_blocks(top, params)
        .groupBy("run_date")
        .agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("body"))
    )
    head = F.concat(
        F.format_string(TITLE, "top_n", F.col("run_date").cast("string")),
        F.lit("\n\n"),
        F.format_string(
            STATS, "total_fetched", "after_dedup", "above_threshold", F.col("threshold").cast("string")
        ),
        F.lit("\n\n"),
    )
    body = F.regexp_replace("body", TRAILING_WHITESPACE, "")
    body = F.coalesce(F.concat(body, F.lit("\n")), F.lit(NOTHING))
    return stats.join(bodies, "run_date", "left").select(
        "run_date", F.concat(head, body).alias("document")
    )


def report_files(documents: DataFrame) -> DataFrame:
    """(run_date, value): the documents as a text writer takes them, which adds the last line break."""
    return documents.select("run_date", F.rtrim("document", F.lit("\n")).alias("value"))


def preview(top: DataFrame) -> DataFrame:
    """Rank, score, title and URL of the top items; nothing is written."""
    return top.select("run_date", "rank", "score", "title", "url")
