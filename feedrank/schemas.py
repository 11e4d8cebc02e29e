"""Schemas shared by the scans, the operators and the sinks."""

from __future__ import annotations

POPULARITY = (
    "STRUCT<stars_total: BIGINT, stars_today: BIGINT, language: STRING, "
    "hn_score: BIGINT, hn_comments: BIGINT>"
)

# One item as a scan emits it. `ord` is the item's position within its run date.
RAW_ITEM = (
    "run_date DATE, ord BIGINT, source STRING, source_name STRING, source_id STRING, "
    "title STRING, url STRING, published_at STRING, summary STRING, "
    f"raw_popularity {POPULARITY}, source_config_id STRING, source_type STRING"
)

ITEM_COLUMNS = (
    "run_date", "ord", "source", "source_name", "source_id", "title", "url", "published_at",
    "summary", "raw_popularity", "source_config_id", "source_type",
)

ENRICHED_COLUMNS = ITEM_COLUMNS + ("canonical_url", "title_norm", "content_hash", "score", "tags")

# One attempt to fetch one part (feed URL, language page, id list) of a source.
LANDED = (
    "run_date DATE, source_config_id STRING, part STRING, status STRING, error STRING, "
    "body STRING, fetched_at TIMESTAMP"
)

# One story payload as landed: `body` is the JSON document, or null if the fetch failed.
LANDED_STORY = "run_date DATE, id BIGINT, body STRING"
