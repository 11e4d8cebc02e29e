"""The source registry: which feeds, pages and lists belong to which source."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedrank.functions.text import strip
from feedrank.sources.defaults import DEFAULT_SOURCES

# --- Fixed values. -----------------------------------------------------------

TYPE_ALIASES = {"rss": "rss", "github": "github_trending", "hn": "hackernews"}

# Parameter that lists the parts of a source, and the parts used when it is empty.
PART_PARAMS = {"rss": "urls", "github_trending": "languages", "hackernews": "feeds"}
DEFAULT_PARTS = {
    "rss": ("https://news.smol.ai/rss.xml",),
    "github_trending": ("python", "cpp", "jupyter-notebook"),
    "hackernews": ("top", "best", "new"),
}
STORY_FEEDS = ("top", "best", "new")
DEFAULT_MAX_PER_FEED = 40
DEFAULT_STORY_KEYWORDS = (
    "ai", "llm", "gpt", "agent", "anthropic", "openai", "copilot", "cursor", "codex",
    "code assistant", "programming",
)

# --- End of fixed values. ----------------------------------------------------


def default_registry(spark: SparkSession) -> DataFrame:
    """The sources a run uses when no registry is given."""
    document = json.dumps({"sources": DEFAULT_SOURCES})
    return parse_registry(spark.createDataFrame([(document,)], "doc STRING"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a JSON registry file `{"sources": [...]}`, in file order."""
    return parse_registry(spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")))


def parse_registry(documents: DataFrame) -> DataFrame:
    """Sources of registry documents in column `doc`, numbered from 0 in `source_pos`."""
    sources = F.variant_get(F.parse_json("doc"), "$.sources", "array<variant>")
    return parse_sources(documents.select(F.posexplode(sources).alias("source_pos", "spec")))


def _param(name: str, kind: str) -> Column:
    return F.try_variant_get("spec", f"$.params.{name}", kind)


def _truth(value: Column) -> Column:
    """Truth of a JSON value as Python sees it; null if the value is absent."""
    kind = F.schema_of_variant(value)
    text = value.try_cast("string")
    return (
        F.when(value.isNull(), None)
        .when(F.is_variant_null(value) | text.isin("", "false", "0", "[]", "{}") & (kind != "STRING"), False)
        .when(kind == "STRING", text != "")
        .when(
            kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")),
            text.try_cast("double") != 0,
        )
        .otherwise(True)
    )


def clean_list(value: Column) -> Column:
    """A list parameter: stripped non-empty strings; a scalar is a list of one."""
    is_list = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
    items = F.when(is_list, value.try_cast("array<string>")).otherwise(
        F.array(value.try_cast("string"))
    )
    stripped = F.transform(items, lambda v: strip(F.coalesce(v, F.lit("None"))))
    missing = value.isNull() | F.is_variant_null(value)
    return F.when(missing, F.array().cast("array<string>")).otherwise(
        F.filter(stripped, lambda v: v != "")
    )


def _or_default(values: Column, default: Iterable[str]) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(F.array(*(F.lit(v) for v in default)))


def parse_sources(specs: DataFrame) -> DataFrame:
    """Typed sources from JSON specs (`source_pos`, variant `spec`); one without id or type
    aborts the job."""
    source_type = F.lower(strip(F.coalesce(F.variant_get("spec", "$.type", "string"), F.lit(""))))
    source_id = strip(F.coalesce(F.variant_get("spec", "$.id", "string"), F.lit("")))
    parts = F.array().cast("array<string>")
    for kind, name in PART_PARAMS.items():
        listed = _or_default(clean_list(_param(name, "variant")), DEFAULT_PARTS[kind])
        parts = F.when(F.col("source_type") == kind, listed).otherwise(parts)

    def required(value: Column, field: str) -> Column:
        message = F.concat(F.lit(f"source without {field} at position "), F.col("source_pos").cast("string"))
        return F.when(value == "", F.raise_error(message).cast("string")).otherwise(value)

    given = F.variant_get("spec", "$.params", "variant")
    is_object = given.isNull() | F.is_variant_null(given) | F.startswith(F.schema_of_variant(given), F.lit("OBJECT"))
    no_object = F.concat(F.lit("params is no object at position "), F.col("source_pos").cast("string"))
    checked_id = F.when(is_object, source_id).otherwise(F.raise_error(no_object).cast("string"))
    per_feed = F.coalesce(_param("max_per_feed", "int"), F.lit(DEFAULT_MAX_PER_FEED))
    return specs.select(
        F.col("source_pos").cast("int").alias("source_pos"),
        required(checked_id, "id").alias("source_config_id"),
        required(source_type, "type").alias("source_type"),
        F.coalesce(_truth(F.variant_get("spec", "$.enabled", "variant")), F.lit(True)).alias("enabled"),
        "spec",
    ).select(
        "source_pos",
        "source_config_id",
        "source_type",
        "enabled",
        parts.alias("parts"),
        F.coalesce(F.nullif(_param("since", "string"), F.lit("")), F.lit("daily")).alias("since"),
        F.greatest(per_feed, F.lit(1)).alias("max_per_feed"),
        _or_default(clean_list(_param("keywords", "variant")), DEFAULT_STORY_KEYWORDS).alias("keywords"),
        F.coalesce(_truth(_param("require_keyword_match", "variant")), F.lit(True)).alias(
            "require_keyword_match"
        ),
    )


def check_registry(registry: DataFrame) -> None:
    """Raise ValueError if there is no source, or if two share an id."""
    if registry.isEmpty():
        raise ValueError("no sources configured")
    twice = registry.groupBy("source_config_id").count().filter("count > 1").collect()
    if twice:
        names = ", ".join(sorted(r["source_config_id"] for r in twice))
        raise ValueError(f"source ids used more than once: {names}")


def parse_source_ids(csv: str | None) -> list[str]:
    """Distinct non-empty ids of a comma-separated list, in order."""
    return list(dict.fromkeys(t.strip() for t in (csv or "").split(",") if t.strip()))


def select_sources(registry: DataFrame, requested: Iterable[str] = ()) -> DataFrame:
    """Enabled sources that were asked for, in the order asked for, as `source_pos`.

    A request is a source id or, failing that, an alias for all sources of a type. No request
    means all. A request that finds nothing raises ValueError.
    """
    enabled = registry.filter("enabled")
    requested = list(requested)
    if not requested:
        return enabled
    spark = registry.sparkSession
    rows = [(i, r, TYPE_ALIASES.get(r.strip().lower())) for i, r in enumerate(requested)]
    wanted = spark.createDataFrame(rows, "request_pos INT, request STRING, alias STRING")
    by_id = enabled.join(wanted, enabled.source_config_id == wanted.request).drop("alias")
    direct = by_id.select("request")
    by_type = enabled.join(
        wanted.join(direct, "request", "left_anti"),
        F.col("alias") == F.col("source_type"),
    ).drop("alias")
    found = by_id.unionByName(by_type)
    missed = wanted.join(found, "request", "left_anti").select("request").collect()
    if missed:
        names = ", ".join(sorted(r["request"] for r in missed))
        raise ValueError(f"no enabled source for: {names}")
    stride = registry.agg(F.max("source_pos")).first()[0] + 1
    place = (F.col("request_pos") * stride + F.col("source_pos")).cast("int")
    first = found.groupBy("source_config_id").agg(F.min(place).alias("source_pos"))
    return registry.drop("source_pos").join(first, "source_config_id")


def source_parts(sources: DataFrame) -> DataFrame:
    """One row per part (URL, language, feed) of every source, numbered in `part_pos`."""
    return sources.select("*", F.posexplode("parts").alias("part_pos", "part")).drop("parts")
