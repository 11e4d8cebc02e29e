"""Trending-repository pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from feedrank.functions.text import clean_text, digits_to_int
from feedrank.functions.times import iso_utc, on_date
from feedrank.sources.landing import landed_parts, popularity, position

REPOSITORY_URL = "https://github.com/"  # fixed value

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
         "track", "wbr"}


class _Rows(HTMLParser):
    """Collects, per repository row, the first anchor of a heading, paragraph, and counters."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self._open: list[tuple[str, str | None]] = []  # (tag, field it fills)
        self._row_depth: int | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attr = dict(attrs)
        classes = set((attr.get("class") or "").split())
        fills = None
        if self._row_depth is None:
            if tag == "article" and "Box-row" in classes:
                self._row_depth = len(self._open)
                self.rows.append({"href": None, "p": None, "total": None, "today": None})
        else:
            fills = self._field(tag, attr, classes)
        if tag not in _VOID:
            self._open.append((tag, fills))

    def _field(self, tag: str, attr: dict, classes: set[str]) -> str | None:
        row = self.rows[-1]
        href = attr.get("href") or ""
        if tag == "a" and row["href"] is None and any(t == "h2" for t, _ in self._open[self._row_depth:]):
            row["href"] = href
        if tag == "p" and row["p"] is None:
            name = "p"
        elif tag == "a" and row["total"] is None and href.endswith("/stargazers"):
            name = "total"
        elif tag == "span" and row["today"] is None and {"d-inline-block", "float-sm-right"} <= classes:
            name = "today"
        else:
            return None
        row[name] = []
        return name

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                del self._open[i:]
                break
        if self._row_depth is not None and len(self._open) <= self._row_depth:
            self._row_depth = None

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if self._row_depth is not None and text:
            for field in {f for _, f in self._open if f}:
                self.rows[-1][field].append(text)


_FIELDS = ("repository", "p", "total", "today")
_ROWS = ArrayType(StructType([StructField(name, StringType()) for name in _FIELDS]))
_ARROW_ROWS = pa.list_(pa.struct([(name, pa.string()) for name in _FIELDS]))


def _repository_rows(body: str | None) -> list[dict]:
    parser = _Rows()
    parser.feed(body or "")
    parser.close()
    found = []
    for row in parser.rows:
        path = re.sub(r"\s+", "", row["href"] or "")
        if path:
            texts = {k: " ".join(row[k] or ()) for k in ("p", "total", "today")}
            found.append({"repository": path.strip("/"), **texts})
    return found


@F.arrow_udf(_ROWS)
def _parse_page(bodies: pa.Array) -> pa.Array:
    return pa.array((_repository_rows(b) for b in bodies.to_pylist()), _ARROW_ROWS)


def parse_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per repository, in page order (`row_pos`), next to the page's other columns."""
    others = [c for c in pages.columns if c != body]
    found = F.posexplode(_parse_page(F.col(body))).alias("row_pos", "row")
    return pages.select(*others, found).select(*others, "row_pos", "row.*")


def repository_items(rows: DataFrame) -> DataFrame:
    """Item fields of repository rows."""
    others = [c for c in rows.columns if c not in _FIELDS]
    return rows.select(
        *others,
        F.lit("github").alias("source"),
        F.lit("github.com").alias("source_name"),
        F.col("repository").alias("source_id"),
        F.col("repository").alias("title"),
        F.concat(F.lit(REPOSITORY_URL), "repository").alias("url"),
        clean_text(F.col("p")).alias("summary"),
        digits_to_int(F.col("total")).alias("stars_total"),
        digits_to_int(F.col("today")).alias("stars_today"),
    )


def scan_trending(landed: DataFrame, parts: DataFrame) -> DataFrame:
    """Items of landed trending pages. The pages show the present only, so a snapshot counts
    for the date it was taken on and no other."""
    pages = (
        landed_parts(landed, parts, "github_trending")
        .filter((F.col("status") == "ok") & on_date(F.col("fetched_at"), F.col("run_date")))
        .select(
            "run_date", "source_config_id", "source_type", "source_pos", "part_pos", "part",
            "fetched_at", "body",
        )
    )
    return repository_items(parse_rows(pages)).select(
        "run_date",
        position(F.col("source_pos"), F.col("part_pos"), F.col("row_pos")).alias("ord"),
        "source",
        "source_name",
        "source_id",
        "title",
        "url",
        iso_utc(F.col("fetched_at")).alias("published_at"),
        "summary",
        popularity(
            stars_total=F.col("stars_total"), stars_today=F.col("stars_today"), language=F.col("part")
        ).alias("raw_popularity"),
        "source_config_id",
        "source_type",
    )
