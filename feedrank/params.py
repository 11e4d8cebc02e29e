"""Tunable parameters of a run, with the published default values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# --- Fixed values: these must stay as they are for results to match. ---------

SOURCE_WEIGHTS = {"rss": 34.0, "github": 28.0, "hn": 24.0}
DEFAULT_SOURCE_WEIGHT = 10.0

KEYWORD_GROUPS = {
    "core": ("ai coding", "code assistant", "code generation", "coding agent", "agentic coding"),
    "tools": ("copilot", "cursor", "claude code", "codex", "aider", "cline", "continue"),
    "mechanism": ("mcp", "rag for code", "repo indexing", "tool calling", "function calling"),
    "engineering": ("code review", "test generation", "bug fix", "refactor", "pr automation"),
    "zh": ("ai编程", "代码助手", "智能编码", "自动化测试", "代码审查"),
}
GROUP_WEIGHTS = {"core": 5.0, "tools": 4.0, "mechanism": 3.0, "engineering": 3.0, "zh": 4.0}

KEYWORD_CAP = 25.0
POPULARITY_CAP = 20.0

# (oldest age in hours, points), inclusive; older items get OLD_ITEM_POINTS.
FRESHNESS_STEPS = ((24, 15.0), (48, 12.0), (72, 10.0), (168, 6.0), (720, 3.0))
OLD_ITEM_POINTS = 1.0

TRACKING_PREFIXES = ("utm_",)
TRACKING_PARAMS = ("spm", "from", "ref", "source", "fbclid", "gclid", "si")

SOURCE_LABELS = {"rss": "RSS", "github": "GitHub", "hn": "Hacker News"}

DEFAULT_THRESHOLD = 45.0
DEFAULT_TOP_N = 10

# --- End of fixed values. ----------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Everything about scoring and selection that a run may override."""

    source_weights: Mapping[str, float] = field(default_factory=lambda: dict(SOURCE_WEIGHTS))
    default_source_weight: float = DEFAULT_SOURCE_WEIGHT
    keyword_groups: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(KEYWORD_GROUPS))
    group_weights: Mapping[str, float] = field(default_factory=lambda: dict(GROUP_WEIGHTS))
    keyword_cap: float = KEYWORD_CAP
    popularity_cap: float = POPULARITY_CAP
    tracking_prefixes: Sequence[str] = TRACKING_PREFIXES
    tracking_params: Sequence[str] = TRACKING_PARAMS
    source_labels: Mapping[str, str] = field(default_factory=lambda: dict(SOURCE_LABELS))
    threshold: float = DEFAULT_THRESHOLD
    top_n: int = DEFAULT_TOP_N

    def weighted_keywords(self) -> list[tuple[str, float]]:
        """(keyword, weight) pairs, group by group."""
        return [
            (keyword, self.group_weights[group])
            for group, keywords in self.keyword_groups.items()
            for keyword in keywords
        ]
