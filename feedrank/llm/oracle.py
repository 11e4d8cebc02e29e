"""SQL counterparts of queries of this subpackage, for an independent engine on the same tables."""

from __future__ import annotations

from feedrank.llm.line_dedup import WORDS
from feedrank.llm.quality_rules import LADDERS, WINDOW, Risk

_RISK = Risk()
_ANY_WORD = r"[^\x20\x09-\x0D]"
_STEPS = ", ".join(
    f"('{rule}', {level}, {'NULL' if cutoff is None else cutoff}::DOUBLE)"
    for rule, ladder in LADDERS.items() for level, cutoff in enumerate((*ladder, None), 1))
_SHARE = _RISK.alpha / len(LADDERS)


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part}::DOUBLE / {whole} ELSE 0.0::DOUBLE END"


_VALUES = " UNION ALL ".join(
    f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, {value} AS value FROM measures"
    for rule, value in {
        "symbol_ratio": _ratio("n_symbols", "word_chars"), "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"), "upper_ratio": _ratio("n_upper", "word_chars"),
        "mean_word": _ratio("word_chars", "n_words"),
    }.items())

OP3 = rf"""WITH cut AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{_ANY_WORD}+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_ANY_WORD}')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM cut)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM repeated) GROUP BY 1
), measures AS (
  SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper,
    len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
  FROM cut LEFT JOIN covered USING (doc_id)
), vals AS ({_VALUES}),
steps(rule, level, cutoff) AS (VALUES {_STEPS}),
good AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
levels AS (
  SELECT v.stratum, v.rule, g.good, substr(md5(v.doc_id::VARCHAR), 1, 1) NOT IN ('0', '1', '2', '3') AS held,
    1 + (SELECT count(*) FROM steps s WHERE s.rule = v.rule AND v.value <= s.cutoff) AS level
  FROM vals v JOIN good g USING (doc_id) WHERE NOT v.base_failed AND v.stratum IS NOT NULL
), curves AS (
  SELECT stratum, rule, level, cutoff,
    sum(a) OVER up AS good_out, sum(a) OVER whole AS good_all, sum(b) OVER up AS tuned_out, sum(b) OVER whole AS tuned_all,
    sum(c) OVER up AS poor_out, sum(c) OVER whole AS poor_all
  FROM (
    SELECT st.stratum, s.rule, s.level, s.cutoff, count(*) FILTER (l.good AND l.held) AS a,
      count(*) FILTER (l.good AND NOT l.held) AS b, count(*) FILTER (NOT l.good AND NOT l.held) AS c
    FROM (SELECT DISTINCT stratum FROM levels) st CROSS JOIN steps s
    LEFT JOIN levels l ON l.stratum = st.stratum AND l.rule = s.rule AND l.level = s.level
    GROUP BY ALL
  ) WINDOW up AS (PARTITION BY stratum, rule ORDER BY level ROWS UNBOUNDED PRECEDING), whole AS (PARTITION BY stratum, rule)
), tested AS (
  SELECT *, CASE WHEN good_out > good_all * {_SHARE} THEN 1.0 ELSE least(1.0, list_sum(list_transform(
      range(0, good_out::BIGINT + 1), lambda i: exp(lgamma(good_all + 1) - lgamma(i + 1) - lgamma(good_all - i + 1)
        + i * ln({_SHARE}) + (good_all - i) * ln(1 - {_SHARE}))))) END AS p,
    poor_out / greatest(poor_all, 1) - {_RISK.loss} * tuned_out / greatest(tuned_all, 1) AS gain
  FROM curves WHERE cutoff IS NOT NULL
), certified AS (
  SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY level ROWS UNBOUNDED PRECEDING) AS worst FROM tested
), cutoffs AS (
  SELECT stratum, rule, cutoff FROM certified
  WHERE worst <= {_RISK.delta} / (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM certified)) AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, level) = 1
), rejected AS (
  SELECT DISTINCT doc_id FROM vals v JOIN cutoffs c ON c.stratum = v.stratum AND c.rule = v.rule AND v.value > c.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM measures"""

OP6 = rf"""WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
), units AS (
  SELECT doc_id, place, line, len(regexp_extract_all(line, '{_ANY_WORD}+')) AS n,
    row_number() OVER (PARTITION BY doc_id ORDER BY place) AS u
  FROM lines WHERE regexp_matches(line, '{_ANY_WORD}')
), ended AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY u) AS e FROM units
), windows AS (
  SELECT doc_id, u AS a, sum(n) OVER r AS total, count(*) OVER r AS c, list(line) OVER r AS content, place AS lo, max(place) OVER r AS hi
  FROM (SELECT *, e - n AS s FROM ended)
  WINDOW r AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {WORDS - 1} FOLLOWING)
  UNION
  SELECT doc_id, min(u) OVER r, sum(n) OVER r, count(*) OVER r, list(line) OVER r, min(place) OVER r, place
  FROM ended WINDOW r AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {WORDS - 1} PRECEDING AND CURRENT ROW)
), spans AS (
  SELECT doc_id, lo AS a, hi AS b FROM windows WHERE total >= {WORDS}
  QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, windows.a) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS place FROM spans),
cut AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS text
  FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place GROUP BY 1
)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines,
  CASE WHEN d.doc_id IN (SELECT doc_id FROM gone) THEN coalesce(c.text, '') ELSE d.text END AS text
FROM documents d LEFT JOIN cut c ON c.doc_id = d.doc_id"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP11 = rf"""WITH items AS (SELECT item_id, {_plain_words('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, {_plain_words('text')} AS w FROM documents),
found AS (
  SELECT doc_id, i, n, s FROM (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))
  ) WHERE s IN (SELECT s FROM windows)
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY 1
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT f.doc_id, v.item_id::VARCHAR AS item FROM found f JOIN windows v ON v.s = f.s WHERE v.item_id IS NOT NULL)
  GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN listed l ON l.doc_id = d.doc_id"""

OP12 = rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (VALUES (1), (2), (3)) lengths(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY 1),
candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS p FROM counts WHERE k > 1 AND f >= 10),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(p[1:2], ' ') AS phrase, f FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(p[2:3], ' '), f FROM candidates WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase
  WHERE c.k = 3 OR g.f IS NULL OR 100 * g.f < 50 * c.f
), rated AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, cut,
    ((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[cut + 1:c.k], ' ')
), lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000"""

OP13 = """WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT * FROM rows WHERE vec_id % 100 = 0) a JOIN rows b ON a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scored WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> n.own
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10"""

ORACLES = {"op3_quality_rules": OP3, "op6_line_dedup": OP6, "op11_decontamination": OP11,
           "op12_collocations": OP12, "op13_hard_negatives": OP13}
