"""The default source registry."""

from __future__ import annotations


def _feed(source_id: str, *urls: str) -> dict:
    return {"id": source_id, "type": "rss", "params": {"urls": list(urls)}}


# The sources and their order, which is part of the order of all items.
DEFAULT_SOURCES = [
    _feed("smol_rss", "https://news.smol.ai/rss.xml"),
    _feed("techcrunch_ai_rss", "https://techcrunch.com/category/artificial-intelligence/feed/"),
    _feed(
        "openai_blog_rss",
        "https://openai.com/blog/rss.xml",
        "https://www.openai.com/blog/rss.xml",
        "https://openai.com/news/rss.xml",
    ),
    _feed("synced_review_rss", "https://syncedreview.com/feed/"),
    _feed("arxiv_cs_ai_rss", "https://rss.arxiv.org/rss/cs.AI"),
    {
        "id": "github_trending_main",
        "type": "github_trending",
        "params": {"languages": ["python", "cpp", "jupyter-notebook"], "since": "daily"},
    },
    {
        "id": "hn_ai",
        "type": "hackernews",
        "params": {"feeds": ["top", "best", "new"], "max_per_feed": 15, "require_keyword_match": True},
    },
    _feed("arxiv_cs_cl_rss", "https://rss.arxiv.org/rss/cs.CL"),
    _feed("arxiv_cs_cv_rss", "https://rss.arxiv.org/rss/cs.CV"),
    _feed("arxiv_cs_lg_rss", "https://rss.arxiv.org/rss/cs.LG"),
    _feed("google_ai_blog_rss", "https://blog.google/technology/ai/rss/"),
    _feed("bair_blog_rss", "https://bair.berkeley.edu/blog/feed.xml"),
    _feed("ars_ai_rss", "https://arstechnica.com/ai/feed/"),
    _feed("ai_business_rss", "https://aibusiness.com/rss.xml"),
    _feed("ai_trends_rss", "https://www.aitrends.com/feed/"),
    _feed("36kr_rss", "https://www.36kr.com/feed"),
    _feed("huxiu_rss", "https://www.huxiu.com/rss/0.xml"),
    _feed("leiphone_rss", "https://www.leiphone.com/feed"),
    _feed("qbitai_rss", "https://www.qbitai.com/feed"),
    _feed("infoq_cn_rss", "https://www.infoq.cn/feed"),
    _feed("juejin_rss", "https://juejin.cn/rss"),
]
