"""SQL counterparts of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

from feedrank.params import Params
from feedrank.plans.tables import (
    FEED_CHUNK,
    FEED_PARTS,
    FEED_SOURCES,
    LANGUAGES,
    LIST_CHUNK,
    LISTS,
    MAX_PER_LIST,
    NOW,
    PAGE_CHUNK,
    PARAMS,
    STORY_KEYWORDS,
)
from feedrank.sinks import report
from feedrank.sources.landing import PART_BITS, ROW_BITS
from feedrank.sources.registry import DEFAULT_STORY_KEYWORDS

ORACLES: dict[str, str] = {}

_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
_NOW = f"TIMESTAMP '{NOW[:19].replace('T', ' ')}'"
_ISO = "%Y-%m-%dT%H:%M:%SZ"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def _unescaped(x: str) -> str:
    """One level, for the entities that occur in the tables."""
    for entity, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"),
                         ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, {_quoted(entity)}, {_quoted(char)})"
    return x


def _normalized(x: str) -> str:
    return _collapsed(_unescaped(x))


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substr({x}, 1, {n - 1})) || '...' END"


def _headline(text: str) -> str:
    return f"split_part({text}, chr(10), 1)"


_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"


def _domain(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?:{_SCHEME}:)?//([^/?#]*)', 1))"


def _canonical(raw: str) -> str:
    url = rf"regexp_replace({raw}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    scheme = f"lower(regexp_extract({url}, '^({_SCHEME}):', 1))"
    path = rf"rtrim(regexp_extract({url}, '^{_SCHEME}://[^/?#]*([^?#]*)', 1), '/')"
    pairs = rf"string_split(regexp_extract({url}, '^[^?#]*\?([^#]*)', 1), '&')"

    def decoded(x: str) -> str:
        return f"url_decode(replace({x}, '+', ' '))"

    def encoded(x: str) -> str:
        return f"replace(url_encode({decoded(x)}), '%20', '+')"

    names = ", ".join(_quoted(n) for n in PARAMS.tracking_params)
    name = decoded("split_part(p, '=', 1)")
    wanted = f"p <> '' AND lower({name}) NOT IN ({names}) AND NOT starts_with(lower({name}), 'utm_')"
    value = "CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END"
    pair = f"{encoded("split_part(p, '=', 1)")} || '=' || {encoded(f'({value})')}"
    query = f"array_to_string(list_transform(list_filter({pairs}, lambda p: {wanted}), lambda p: {pair}), '&')"
    return f"""CASE WHEN {scheme} = '' OR {_domain(url)} = '' THEN {url}
        ELSE {scheme} || '://' || {_domain(url)} || coalesce(nullif({path}, ''), '/')
          || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"""


def _keyword_points(text: str, params: Params = PARAMS) -> str:
    terms = " + ".join(
        f"CASE WHEN contains({text}, {_quoted(k.lower())}) THEN {w} ELSE 0 END"
        for k, w in params.weighted_keywords()
    )
    return f"CAST(least({terms}, {params.keyword_cap}) AS DOUBLE)"


def _tags(text: str) -> str:
    found = ", ".join(
        f"CASE WHEN contains({text}, {_quoted(k.lower())}) THEN {_quoted(k)} END"
        for k in sorted({k for k, _ in PARAMS.weighted_keywords()})
    )
    return f"coalesce(array_to_string(list_filter([{found}], lambda k: k IS NOT NULL), ','), '')"


def _weight(source: str) -> str:
    return f"CASE {source} WHEN 'rss' THEN 34.0::DOUBLE WHEN 'github' THEN 28.0 WHEN 'hn' THEN 24.0 ELSE 10.0 END"


def _label(source: str) -> str:
    return (
        f"CASE lower({source}) WHEN 'rss' THEN 'RSS' WHEN 'github' THEN 'GitHub' "
        f"WHEN 'hn' THEN 'Hacker News' ELSE coalesce(nullif(lower({source}), ''), '-') END"
    )


def _popularity(source: str, today: str, total: str, votes: str, comments: str) -> str:
    return f"""CASE {source}
        WHEN 'github' THEN least({today}::DOUBLE / 25.0::DOUBLE + {total}::DOUBLE / 50000.0::DOUBLE, 20.0::DOUBLE)
        WHEN 'hn' THEN least({votes}::DOUBLE / 12.0::DOUBLE + {comments}::DOUBLE / 25.0::DOUBLE, 20.0::DOUBLE)
        ELSE 0.0::DOUBLE END"""


def _freshness(ts: str, now: str = _NOW) -> str:
    age = f"(epoch_us({now}) - epoch_us({ts}))"
    steps = " ".join(
        f"WHEN {age} <= {hours} * 3600000000 THEN {points}"
        for hours, points in ((24, 15.0), (48, 12.0), (72, 10.0), (168, 6.0), (720, 3.0))
    )
    return f"CAST(CASE {steps} ELSE 1.0 END AS DOUBLE)"


def _rounded(x: str) -> str:
    """Exact rounding to two decimals, half to even, for scores from 8 up to 128."""
    scaled = f"(CAST({x} * 562949953421312.0::DOUBLE AS HUGEINT) * 100)"
    down, rest = f"({scaled} // 562949953421312)", f"({scaled} % 562949953421312)"
    up = f"({rest} > 281474976710656 OR ({rest} = 281474976710656 AND {down} % 2 = 1))"
    return f"CAST({down} + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / 100.0::DOUBLE"


# --- items -------------------------------------------------------------------

_ITEMS = f"""items AS (
  SELECT CAST(e.ts AS DATE) AS run_date, d.doc_id AS ord,
    ['rss', 'github', 'hn', 'blog'][d.doc_id % 4 + 1] AS source,
    CASE WHEN d.doc_id % 5 <> 0 THEN d.source || ':' || d.n_chars END AS source_id,
    {_headline('d.text')} AS raw_title,
    split_part(p.url, '#', 1) || CASE WHEN contains(split_part(p.url, '#', 1), '?') THEN '&' ELSE '?' END
      || 'd=' || (d.doc_id % 3) AS url,
    CASE WHEN d.doc_id % 17 <> 0 THEN strftime(e.ts, '{_ISO}') END AS published_at,
    d.text AS raw_summary,
    CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k,
    CAST(trunc(e.value) AS BIGINT) AS votes,
    d.source AS source_config_id
  FROM documents d
  JOIN pages p ON p.page_id = length(d.text) % (SELECT count(*) FROM pages)
  JOIN events e ON e.event_id = d.doc_id * 7919 % (SELECT count(*) FROM events)
), identified AS (
  SELECT *, {_normalized('raw_title')} AS title, {_canonical('url')} AS canonical_url
  FROM items WHERE {_normalized('raw_title')} <> ''
), hashed AS (
  SELECT *, lower(title) AS title_norm, {_domain('canonical_url')} AS domain,
    sha256(lower(title) || '|' || {_domain('canonical_url')} || '|' || coalesce(source_id, url)) AS content_hash
  FROM identified
)"""

_ENRICHED = f"""{_ITEMS}, texts AS (
  SELECT *, {_normalized('raw_summary')} AS summary FROM hashed
), haystacks AS (
  SELECT *, lower(title || chr(10) || summary) AS hay,
    coalesce(strptime(published_at, '{_ISO}'), {_NOW}) AS published
  FROM texts
), scored AS (
  SELECT *, {_tags('hay')} AS tags,
    {_weight('source')} + {_keyword_points('hay')}
      + {_popularity('source', 'votes', 'k * 250', 'votes', 'k')} + {_freshness('published')} AS total
  FROM haystacks
), enriched AS (
  SELECT strftime(run_date, '%Y-%m-%d') AS run_date, ord, source, source_id, title, url, summary,
    strftime(published, '{_ISO}') AS published_at, canonical_url, title_norm, domain, content_hash,
    tags, {_rounded('total')} AS score
  FROM scored
)"""


def _fold(relation: str, scope: str) -> str:
    """Keys of the items in order, and the fold over them, one position of every scope at a time."""
    return f"""numbered AS (
  SELECT {scope} AS scope, ord, row_number() OVER (PARTITION BY {scope} ORDER BY ord) AS rn,
    list_filter([
      CASE WHEN canonical_url <> '' THEN md5('u' || canonical_url) END,
      CASE WHEN title_norm <> '' AND domain <> '' THEN md5('t' || domain || chr(1) || title_norm) END,
      md5('h' || content_hash)], lambda k: k IS NOT NULL) AS keys
  FROM {relation}
), fold AS (
  SELECT scope, ord, rn, true AS kept, keys AS seen FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.scope, n.ord, n.rn, NOT list_has_any(f.seen, n.keys),
    CASE WHEN list_has_any(f.seen, n.keys) THEN f.seen ELSE list_concat(f.seen, n.keys) END
  FROM fold f JOIN numbered n ON n.scope = f.scope AND n.rn = f.rn + 1
), survivors AS (SELECT scope, ord FROM fold WHERE kept)"""


_DEDUPED = f"""{_ENRICHED}, {_fold('enriched', 'run_date')}, deduped AS (
  SELECT e.* FROM enriched e JOIN survivors s ON s.ord = e.ord
)"""
_RANKING = "score DESC, published_at ASC, ord ASC"
_TOP = f"""{_DEDUPED}, top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_date ORDER BY {_RANKING}) AS INTEGER) AS rank
  FROM deduped WHERE score >= {PARAMS.threshold}
  QUALIFY rank <= {PARAMS.top_n}
)"""
_SHOWN = "run_date, ord, source, title, url, published_at, score, tags"

ORACLES["dedup_items"] = f"""WITH RECURSIVE {_ITEMS}, {_fold('hashed', "''")}
SELECT h.ord, h.canonical_url, h.content_hash FROM hashed h JOIN survivors s ON s.ord = h.ord"""
ORACLES["dedup_items_by_day"] = f"WITH RECURSIVE {_DEDUPED} SELECT run_date, ord, score FROM deduped"
_LINKED = """SELECT doc_id AS ord, sha256(text) AS content_hash, {domain} AS domain, {url} AS canonical_url, {title} AS title_norm
  FROM documents"""
_HOT = _LINKED.format(
    domain="CASE WHEN doc_id % 3 = 0 THEN 'hot.example.com' ELSE 'h' || greatest(doc_id % 9 - 5, 0) || '.example.com' END",
    url="CASE WHEN doc_id % 3 = 0 THEN 'http://hot.example.com/one' "
    "ELSE 'http://h' || greatest(doc_id % 9 - 5, 0) || '.example.com/' || doc_id END",
    title="CASE WHEN doc_id % 3 = 1 THEN 'one title' ELSE 'title ' || doc_id END")
_CHAIN = _LINKED.format(
    domain="'chain.example.com'", url="'http://chain.example.com/' || (doc_id + 1) // 2", title="'title ' || doc_id // 2")
_BRAID = _LINKED.format(
    domain="'braid.example.com'", url="'http://braid.example.com/' || doc_id // 3",
    title="'title ' || (doc_id + CASE WHEN doc_id % 1000 < 700 THEN 1 ELSE 2 END) // 3")
for _name, _rows in (("dedup_hot_key", _HOT), ("dedup_long_chain", _CHAIN), ("dedup_braid", _BRAID)):
    ORACLES[_name] = f"""WITH RECURSIVE linked AS ({_rows}), {_fold('linked', "''")}
SELECT l.ord, l.canonical_url FROM linked l JOIN survivors s ON s.ord = l.ord"""
ORACLES["daily_one_date"] = (
    f"WITH RECURSIVE {_TOP} SELECT {_SHOWN}, rank, summary FROM top WHERE run_date = '2024-01-29'"
)
ORACLES["daily_top_news"] = f"WITH RECURSIVE {_TOP} SELECT {_SHOWN}, rank, summary FROM top"
ORACLES["enrich_items"] = f"""WITH {_ENRICHED}
SELECT {_SHOWN}, source_id, summary, canonical_url, title_norm, content_hash FROM enriched"""
ORACLES["threshold_select"] = (
    f"WITH {_ENRICHED} SELECT ord, score FROM enriched WHERE score >= {PARAMS.threshold}"
)
ORACLES["top_n_global"] = f"""WITH {_ENRICHED}
SELECT CAST(row_number() OVER (ORDER BY {_RANKING}) AS INTEGER) AS rank, score, title, url FROM enriched
ORDER BY {_RANKING} LIMIT 25"""
ORACLES["top_n_per_day"] = f"""WITH {_ENRICHED}
SELECT {_SHOWN}, CAST(row_number() OVER (PARTITION BY run_date ORDER BY {_RANKING}) AS INTEGER) AS rank FROM enriched
QUALIFY rank <= 5"""
ORACLES["content_hash"] = f"WITH {_ITEMS} SELECT ord, content_hash FROM hashed"
ORACLES["defaults_fill"] = f"""WITH {_ITEMS}
SELECT ord, coalesce(source_id, url) AS source_id, coalesce(published_at, '{NOW}') AS published_at FROM items"""

_STATS = f"""{_TOP}, stats AS (
  SELECT strftime(i.run_date, '%Y-%m-%d') AS run_date, count(*) AS total_fetched,
    count(d.ord) AS after_dedup, count(*) FILTER (d.score >= {PARAMS.threshold}) AS above_threshold
  FROM items i LEFT JOIN deduped d ON d.ord = i.ord GROUP BY 1
)"""
ORACLES["run_stats"] = f"""WITH RECURSIVE {_STATS}
SELECT *, least({PARAMS.top_n}, above_threshold) AS top_n, {PARAMS.threshold}::DOUBLE AS threshold,
  '{NOW}' AS generated_at FROM stats"""
ORACLES["raw_items"] = f"""WITH RECURSIVE {_STATS}
SELECT {_SHOWN}, summary, canonical_url, title_norm, content_hash, total_fetched, after_dedup, '{NOW}' AS generated_at
FROM deduped JOIN stats USING (run_date)"""
ORACLES["source_counts"] = f"""WITH {_ITEMS}
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, source_config_id, count(*) AS fetched
FROM items GROUP BY ALL"""


def _filled(template: str, *values: str) -> str:
    """A %s template with SQL values put in."""
    parts = template.split("%s")
    pieces = [_quoted(parts[0]).replace("\n", "' || chr(10) || '")]
    for value, part in zip(values, parts[1:], strict=True):
        pieces += [f"({value})", _quoted(part).replace("\n", "' || chr(10) || '")]
    return " || ".join(pieces)


_BLOCK = (
    _filled(report.HEADING, "rank", "title") + " || chr(10) || "
    + _filled(report.FIELDS, _label("source"), "score::VARCHAR", "published_at",
              "CASE WHEN tags = '' THEN '-' ELSE replace(tags, ',', ', ') END", "url")
    + f" || CASE WHEN summary = '' THEN '' ELSE chr(10) || {_quoted(report.SUMMARY)} || "
    "CASE WHEN regexp_matches(summary, '[\\x{4E00}-\\x{9FFF}]') THEN summary "
    "ELSE '（原文为英文，未做机器翻译）' END END"
)
ORACLES["report_blocks"] = f"WITH RECURSIVE {_TOP} SELECT run_date, rank, {_BLOCK} AS block FROM top"
ORACLES["report_documents"] = f"""WITH RECURSIVE {_STATS}, bodies AS (
  SELECT run_date, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank) AS body FROM top GROUP BY 1
)
SELECT run_date, {_filled(report.TITLE, f"least({PARAMS.top_n}, above_threshold)", "run_date")}
  || chr(10) || chr(10)
  || {_filled(report.STATS, "total_fetched", "after_dedup", "above_threshold", f"{PARAMS.threshold}::DOUBLE")}
  || chr(10) || chr(10) || coalesce(body || chr(10), {_quoted(report.NOTHING)}) AS document
FROM stats LEFT JOIN bodies USING (run_date)"""

# --- addresses ---------------------------------------------------------------

_AWKWARD = (
    f"' HTTPS://User@Example.COM:80/' || source || '//?UTM_X=1&Ref=2&e&&q=' || "
    f"replace(replace(text, '%', ' '), chr(10), '') || '&t=a+b%20~*#top'"
)
ORACLES["url_canonical"] = f"""WITH addresses AS (
  SELECT 'page' AS kind, page_id AS id, url FROM pages
  UNION ALL SELECT 'document', doc_id, {_AWKWARD} FROM documents
)
SELECT kind, id, {_canonical('url')} AS canonical_url FROM addresses"""
ORACLES["link_resolve"] = """WITH tails AS (
  SELECT doc_id, 't' || translate(coalesce(text, ''), '/?#:', '    ') AS tail,
    'http://' || coalesce(source, 'none') || '.example.com/' AS site, coalesce(lang, 'und') AS top FROM documents
)
SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN site || top || '/b/g' || tail
  WHEN 1 THEN site || top || '/b/' || tail || '/' WHEN 2 THEN site || top || '/' || tail
  WHEN 3 THEN site || tail || '/' WHEN 4 THEN site || 'x/' || tail
  WHEN 5 THEN 'http://Other.example.com/' || tail WHEN 6 THEN site || top || '/b/c;p?y=' || tail
  WHEN 7 THEN site || top || '/b/c;p?q=' || doc_id || '#' || tail WHEN 8 THEN 'https://else.example.com/' || tail
  WHEN 9 THEN 'mailto:' || tail WHEN 10 THEN site || top || '/b/' || tail || '?a/../b'
  ELSE site || top || '/b/c;p?q=' || doc_id END AS url
FROM tails"""
ORACLES["url_domain"] =f"SELECT page_id, {_domain('upper(url)')} AS domain FROM pages"
ORACLES["source_name"] = f"SELECT page_id, {_domain('url')} AS name, 'rss' AS name_without_host FROM pages"
ORACLES["link_date"] = """SELECT event_id, CASE event_id % 4
  WHEN 0 THEN strftime(ts, '20%y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d')
  WHEN 2 THEN strftime(try_strptime(strftime(ts, '2024-02-%d'), '%Y-%m-%d'), '%Y-%m-%d') END AS link_date
FROM events"""

# --- text --------------------------------------------------------------------

_RAW = """WITH raws AS (
  SELECT 'document' AS kind, doc_id AS id, text AS raw FROM documents
  UNION ALL SELECT 'page', page_id, html FROM pages
)"""
ORACLES["title_normalize"] = f"""{_RAW}, titles AS (SELECT kind, id, {_normalized('raw')} AS title FROM raws)
SELECT kind, id, title, lower(title) AS title_norm FROM titles WHERE title <> ''"""
ORACLES["text_truncate"] = f"""{_RAW}, texts AS (SELECT kind, id, {_normalized('raw')} AS t FROM raws)
SELECT kind, id, {_cut('t', 300)} AS title, {_cut('t', 800)} AS summary FROM texts"""
ORACLES["digits_to_int"] = """SELECT event_id,
  CAST(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT) AS k,
  CAST(regexp_replace(value::VARCHAR, '[^0-9]', '', 'g') AS BIGINT) AS stars, 0::BIGINT AS none
FROM events"""
ORACLES["cjk_summary"] = """SELECT doc_id, CASE lang WHEN 'de' THEN text || ' 智能编码' WHEN 'es' THEN NULL
  ELSE '（原文为英文，未做机器翻译）' END AS summary_line FROM documents"""
ORACLES["param_list_clean"] = rf"""WITH lists AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [lang] WHEN 1 THEN []
    ELSE list_filter(list_transform(string_split(text, chr(10)),
      lambda v: regexp_replace(v, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda v: v <> '') END AS items
  FROM documents
)
SELECT doc_id, CAST(len(items) AS INTEGER) AS n, coalesce(array_to_string(items, '|'), '') AS items FROM lists"""

# --- times -------------------------------------------------------------------

ORACLES["iso_time"] = f"""WITH written AS (
  SELECT event_id, CASE WHEN event_id % 9 <> 8 THEN strftime(ts, '{_ISO}') END AS iso FROM events
)
SELECT event_id, iso, epoch_us(coalesce(strptime(iso, '{_ISO}'), {_NOW})) AS micros FROM written"""
ORACLES["entry_timestamp"] = f"""WITH seconds AS (
  SELECT event_id, date_trunc('second', ts) AS ts, date_trunc('minute', ts) AS minute, CAST(ts AS DATE) AS day
  FROM events
)
SELECT event_id, strftime(CASE event_id % 8 WHEN 0 THEN ts WHEN 1 THEN minute + INTERVAL 5 HOUR
    WHEN 2 THEN ts - INTERVAL 330 MINUTE WHEN 3 THEN ts WHEN 4 THEN ts + INTERVAL 2 HOUR
    WHEN 5 THEN day WHEN 6 THEN day END, '{_ISO}') AS entry_time
FROM seconds"""
ORACLES["date_filter"] = f"""SELECT event_id, event_type, strftime(ts, '{_ISO}') AS ts FROM events
WHERE CAST(ts AS DATE) = DATE '2024-01-15'"""
ORACLES["snapshot_gate"] = """SELECT event_id, strftime(ts, '%Y-%m-%d') AS run_date FROM events
WHERE event_id % 3 <> 2"""

# --- scores ------------------------------------------------------------------

ORACLES["keyword_tags"] = f"SELECT doc_id, {_tags('lower(text)')} AS tags FROM documents"
ORACLES["keyword_score"] = f"""{_RAW}
SELECT kind, id, {_keyword_points('lower(raw)')} AS points,
  {_keyword_points('lower(raw)', Params())} AS built_in_points FROM raws"""
ORACLES["keyword_relevance"] = "SELECT doc_id FROM documents WHERE " + " OR ".join(
    f"contains(lower(text), {_quoted(k)})" for k in DEFAULT_STORY_KEYWORDS
)
ORACLES["keyword_join"] = f"""WITH keywords(keyword_group, keyword, weight) AS (VALUES {", ".join(
    f"({_quoted(g)}, {_quoted(k)}, {PARAMS.group_weights[g]}::DOUBLE)"
    for g, ks in PARAMS.keyword_groups.items() for k in ks
)})
SELECT doc_id, keyword_group, keyword, weight FROM documents JOIN keywords ON contains(lower(text), keyword)"""
_K, _VOTES = "CAST(json_extract_string(props, '$.k') AS BIGINT)", "CAST(trunc(value) AS BIGINT)"
ORACLES["popularity_score"] = "SELECT event_id, " + ", ".join(
    f"{_popularity(_quoted(s), _VOTES, f'({_K} * 25000)', _VOTES, _K)} AS {s}"
    for s in ("github", "hn", "rss")
) + " FROM events"
ORACLES["freshness_score"] = f"""WITH hours AS (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts FROM events
)
SELECT event_id, {_freshness('ts')} AS points,
  {_freshness('ts', "TIMESTAMP '2024-01-20 00:00:00'")} AS early_points FROM hours"""
_LINE_SOURCE = "['rss', 'github', 'hn', 'RSS', 'blog'][l_orderkey % 5 + 1]"
ORACLES["source_weight"] = (
    f"SELECT l_orderkey, l_linenumber, {_weight(_LINE_SOURCE)} AS weight FROM lineitem"
)
ORACLES["source_label"] = f"""SELECT l_orderkey, l_linenumber, {_label(_LINE_SOURCE)} AS label,
  {_label("nullif(l_returnflag, 'N')")} AS flag_label FROM lineitem"""
ORACLES["total_score"] = f"""WITH totals AS (
  SELECT l_orderkey, l_linenumber, {_weight(_LINE_SOURCE)} + l_tax * 100.0::DOUBLE
    + {_popularity(_LINE_SOURCE, "trunc(l_quantity)", "(l_partkey * 250)", "l_suppkey", "trunc(l_quantity)")}
    + {_freshness("l_shipdate", "TIMESTAMP '1998-06-01 00:00:00'")} AS total
  FROM lineitem
)
SELECT l_orderkey, l_linenumber, {_rounded('total')} AS score FROM totals"""

ORACLES["dedup_single_key"] = (
    "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL"
)

# --- sources -----------------------------------------------------------------

_DAY_BEFORE = "CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END"
_PUBLISHED = (
    f"(run_date - {_DAY_BEFORE})::TIMESTAMP + to_seconds(CAST(doc_id * 7919 % 86400 AS INTEGER))"
)


def _day(chunks_per_day: int) -> str:
    return f"DATE '2024-01-01' + CAST(chunk // {chunks_per_day} AS INTEGER)"


def _ord(source_pos: str, part_pos: str, row_pos: str) -> str:
    return (
        f"CAST(({source_pos}) * {2 ** (PART_BITS + ROW_BITS)} + ({part_pos}) * {2**ROW_BITS} "
        f"+ ({row_pos}) AS BIGINT)"
    )


_FEEDS = f"""feed_docs AS (
  SELECT *, doc_id // {FEED_CHUNK} AS chunk, doc_id % 10 = 9 AS by_link FROM documents
), feed_days AS (SELECT *, {_day(FEED_SOURCES * FEED_PARTS)} AS run_date FROM feed_docs),
feed_entries AS (
  SELECT *, date_trunc('day', {_PUBLISHED}) AS day,
    CASE WHEN by_link THEN date_trunc('day', {_PUBLISHED}) ELSE {_PUBLISHED} END AS published,
    CASE WHEN by_link THEN 'https://News.example.com/issues/' || strftime({_PUBLISHED}, '%Y-%m-%d') || '-' || doc_id
      ELSE 'https://news.example.com/' || source || '/' || doc_id END AS link,
    {_collapsed(_headline('text'))} AS line, {_collapsed('text')} AS body
  FROM feed_days
), feeds AS (
  SELECT strftime(run_date, '%Y-%m-%d') AS run_date,
    {_ord(f'chunk % {FEED_SOURCES}', f'chunk // {FEED_SOURCES} % {FEED_PARTS}', f'doc_id % {FEED_CHUNK}')} AS ord,
    'rss' AS source, 'news.example.com' AS source_name,
    CASE WHEN doc_id % 3 = 0 THEN 'guid-' || doc_id ELSE link END AS source_id,
    {_cut('line', 300)} AS title, link AS url, strftime(published, '{_ISO}') AS published_at,
    {_cut('body', 800)} AS summary, NULL::BIGINT AS stars_total, NULL::BIGINT AS stars_today,
    NULL::VARCHAR AS language, NULL::BIGINT AS hn_score, NULL::BIGINT AS hn_comments,
    'feed' || (chunk % {FEED_SOURCES}) AS source_config_id, 'rss' AS source_type
  FROM feed_entries
  WHERE chunk % 10 <> 9 AND chunk % 11 <> 5 AND day = run_date AND line <> ''
)"""
_SOURCES_BEFORE_TRENDING = FEED_SOURCES
_LANGUAGE = "[" + ", ".join(_quoted(name) for name in LANGUAGES) + "][chunk % 3 + 1]"


def _pages(dropped: str) -> str:
    return f"""page_docs AS (SELECT *, doc_id // {PAGE_CHUNK} AS chunk FROM documents),
page_days AS (
  SELECT *, {_day(len(LANGUAGES))} AS run_date, {_collapsed("text || ' ' || lang")} AS body FROM page_docs
), page_items AS (
  SELECT strftime(run_date, '%Y-%m-%d') AS run_date,
    {_ord(str(_SOURCES_BEFORE_TRENDING), 'chunk % 3', f'doc_id % {PAGE_CHUNK}')} AS ord,
    'github' AS source, 'github.com' AS source_name, source || '/repo' || doc_id AS source_id,
    source || '/repo' || doc_id AS title, 'https://github.com/' || source || '/repo' || doc_id AS url,
    strftime(run_date, '%Y-%m-%dT00:00:00Z') AS published_at, {_cut('body', 800)} AS summary,
    n_chars * 7 AS stars_total, n_chars % 997 AS stars_today, {_LANGUAGE} AS language,
    NULL::BIGINT AS hn_score, NULL::BIGINT AS hn_comments,
    'trending' AS source_config_id, 'github_trending' AS source_type
  FROM page_days
  WHERE chunk % 9 <> 8 AND chunk % 5 <> 4 AND run_date NOT IN ({dropped})
)"""


_FAILED_PAGES = """SELECT run_date FROM page_days WHERE chunk % 9 = 8 AND chunk % 5 <> 4"""
_LISTED = f"""list_docs AS (SELECT *, doc_id // {LIST_CHUNK} AS chunk FROM documents),
list_days AS (
  SELECT *, {_day(1)} AS run_date, count(*) OVER (PARTITION BY chunk) AS size,
    row_number() OVER (PARTITION BY chunk ORDER BY doc_id) - 1 AS place
  FROM list_docs
), listed AS (
  SELECT *, 0 AS part_pos, place AS row_pos FROM list_days
  UNION ALL SELECT *, 1, size - 1 - place FROM list_days
  UNION ALL SELECT *, 2, CASE WHEN place >= size // 2 THEN place - size // 2 ELSE place + size - size // 2 END
  FROM list_days WHERE chunk % 8 <> 7
), merged AS (
  SELECT run_date, chunk, doc_id, min({_ord('0', 'part_pos', 'row_pos')}) AS ord
  FROM listed WHERE row_pos < {MAX_PER_LIST} AND chunk % 8 <> 5 GROUP BY ALL
)"""
_TABLE_HITS = """WITH words AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS keyword FROM benchmark),
keywords AS (
  SELECT DISTINCT 'letters ' || length(keyword) % 5 AS keyword_group, keyword, (length(keyword) % 4 + 0.1)::DOUBLE AS weight FROM words
  UNION SELECT 'begin', substr(text, 1, 90), 7.5::DOUBLE FROM benchmark
), hits AS (
  SELECT doc_id, keyword_group, keyword, weight FROM documents JOIN keywords ON contains(lower(text), lower(keyword)) WHERE keyword <> ''
)"""
ORACLES["keyword_table_join"] = f"{_TABLE_HITS} SELECT * FROM hits"
ORACLES["keyword_table_score"] = f"""{_TABLE_HITS}
SELECT doc_id, least(coalesce(sum(weight::DECIMAL(28, 8))::DOUBLE, 0.0), 60.0)::DOUBLE AS points
FROM documents LEFT JOIN hits USING (doc_id) GROUP BY 1"""

_RELEVANT = " OR ".join(f"contains(hay, {_quoted(k)})" for k in STORY_KEYWORDS)


def _stories(condition: str) -> str:
    return f"""{_LISTED}, payloads AS (
  SELECT m.run_date, m.chunk, m.ord, d.*, {_PUBLISHED.replace('doc_id', 'd.doc_id').replace('run_date', 'm.run_date')} AS published,
    lower({_headline('d.text')} || ' ' || d.text || ' ' ||
      CASE WHEN d.doc_id % 6 <> 5 THEN 'https://stories.example.com/' || d.doc_id ELSE '' END) AS hay,
    {_collapsed(_headline('d.text'))} AS line, {_collapsed('d.text')} AS body
  FROM merged m JOIN documents d ON d.doc_id = m.doc_id
), story_items AS (
  SELECT strftime(run_date, '%Y-%m-%d') AS run_date,
    {_ord(str(_SOURCES_BEFORE_TRENDING + 1), '0', '0')} + ord AS ord,
    'hn' AS source, 'news.ycombinator.com' AS source_name, doc_id::VARCHAR AS source_id,
    {_cut('line', 300)} AS title,
    CASE WHEN doc_id % 6 <> 5 THEN 'https://stories.example.com/' || doc_id
      ELSE 'https://news.ycombinator.com/item?id=' || doc_id END AS url,
    strftime(published, '{_ISO}') AS published_at, {_cut('body', 500)} AS summary,
    NULL::BIGINT AS stars_total, NULL::BIGINT AS stars_today, NULL::VARCHAR AS language,
    n_chars % 500 AS hn_score, CASE WHEN doc_id % 7 <> 6 THEN n_chars % 90 ELSE 0 END AS hn_comments,
    'stories' AS source_config_id, 'hackernews' AS source_type
  FROM payloads
  WHERE doc_id % 11 <> 10 AND doc_id % 13 <> 12 AND doc_id % 19 <> 18 AND doc_id % 4 <> 3
    AND line <> '' AND ({_RELEVANT}) AND {condition}
)"""


ORACLES["scan_feed_items"] = f"WITH {_FEEDS} SELECT * FROM feeds"
ORACLES["scan_html_rows"] = f"WITH {_pages('SELECT NULL::DATE WHERE false')} SELECT * FROM page_items"
ORACLES["feed_merge_distinct"] = f"""WITH {_LISTED}
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, 'stories' AS source_config_id, doc_id AS id, ord FROM merged"""
ORACLES["story_scan_join"] = f"WITH {_stories('true')} SELECT * FROM story_items"
ORACLES["source_union"] = f"""WITH {_FEEDS}, {_pages(_FAILED_PAGES)}, {_stories('chunk % 8 <> 7')}
SELECT * FROM feeds UNION ALL SELECT * FROM page_items UNION ALL SELECT * FROM story_items"""

_EMPTY_FEED = f"""{_FEEDS}, feed_parts AS (
  SELECT DISTINCT run_date, chunk, 'feed' || (chunk % {FEED_SOURCES}) AS source_config_id,
    'https://feeds.example.com/' || (chunk % {FEED_SOURCES}) || '/' || (chunk // {FEED_SOURCES} % {FEED_PARTS})
      AS part
  FROM feed_days
)"""
ORACLES["fetch_failure_policy"] = f"""WITH {_EMPTY_FEED},
{_pages('SELECT NULL::DATE WHERE false')}, {_LISTED}, warnings AS (
  SELECT run_date, source_config_id,
    string_agg(part || CASE WHEN chunk % 10 = 9 THEN ': HTTP 503' ELSE ': body is no feed' END, '; ' ORDER BY part) AS reason
  FROM feed_parts WHERE chunk % 10 = 9 OR chunk % 11 = 5 GROUP BY ALL
  HAVING (strftime(run_date, '%Y-%m-%d'), source_config_id)
    NOT IN (SELECT (run_date, source_config_id) FROM feeds)
  UNION ALL SELECT DISTINCT run_date, 'trending', 'HTTP 429' FROM ({_FAILED_PAGES})
  UNION ALL SELECT DISTINCT run_date, 'stories', CASE WHEN chunk % 8 = 7 THEN 'HTTP 500' ELSE 'body is no list' END
  FROM list_days WHERE chunk % 8 IN (5, 7)
)
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, source_config_id,
  source_config_id || ' failed: ' || reason AS message FROM warnings"""

ORACLES["registry_select"] = """WITH numbered AS (
  SELECT source, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS number, count(*) AS documents
  FROM documents GROUP BY ALL
), sources AS (
  SELECT *, ['rss', 'github_trending', 'hackernews'][number % 3 + 1] AS source_type,
    (SELECT max(number) + 1 FROM numbered) AS stride
  FROM numbered WHERE number % 4 <> 3
), chosen AS (
  SELECT *, CASE WHEN source = 'src4' THEN 0 WHEN source_type = 'hackernews' THEN 1
    WHEN source = 'src1' THEN 2 END AS request FROM sources
)
SELECT source AS source_config_id, source_type, CAST(request * stride + number AS INTEGER) AS source_pos, documents
FROM chosen WHERE request IS NOT NULL"""

# Fetching again settles to the same attempts.
ORACLES["retried_items"] = ORACLES["source_union"]
ORACLES["fetch_retries"] = ORACLES["fetch_failure_policy"]
# So do feeds in whatever bytes they land, and however their links are written.
ORACLES["scan_feed_bytes"] = ORACLES["scan_feed_relative"] = ORACLES["scan_feed_items"]
