"""Phrases of two or three words that are more than chance, per language, by prefix-free parsing.

A text is parsed into chunks that overlap by two words: a chunk begins where two words in a row have a hash that is
divisible by `modulus` (and at the beginning of the text, and after `longest` words), and ends with the two words
that begin the next one. Where chunks begin depends on the words alone, so texts that share passages share chunks,
and a corpus becomes a dictionary of distinct chunks with the number of times each occurs. All phrases of up to three words
lie inside chunks. They are counted in the dictionary only, as often as the chunk occurs, and a phrase that lies
in an overlap counts for the later chunk: the one in which its first word is not among the last two.

Most distinct phrases are rare, so the dictionary is read twice. First all phrases are counted by hashes of 43 bits, which
are summed in the tasks, dealt to 2048 parts and summed again: a phrase can be frequent only if its hash is. A fixed 32 MB of
bits, of which a part makes its own, tells which hashes are, and lets some others pass, more when there are very many. Then the
phrases that pass are counted themselves, so what shares a hash or passes by chance is dropped and no count depends on a hash.
These counts, too, are summed in the tasks before they are shuffled, and a phrase is its own key, so one that is everywhere
costs few rows a task. Candidates are joined with the counts of their parts by language and part. The best of a language are
cut in each task, then in many parts, then as a whole.

Defined results: null and empty texts have no words; a null language counts as `und`, together with texts of
that language; repeated rows count as often as they come; very long texts are parsed whole, and a text without a place to cut
is cut all `longest` words, which changes no count; of cuts with equal scores the first counts; equal scores and counts are
ordered by the bytes of the phrase; an empty table gives no rows; other columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.llm.common import rows_of, stored
from feedrank.llm.hashed_words import Texts, grouped, mixed, passing, shingles
from feedrank.operators.rank import first_of_each

#: Upper-case ASCII letters become lower-case, what ends a piece a line feed, and tabs spaces.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))
_SAME = bytes(range(256))
_GAP = np.array([b in (10, 32) for b in range(256)])
#: What follows the last chunk of a text instead of two more words.
_END = b"\n\n"
COUNTS = "lang string, phrase string, times long"
#: Keys of phrases: the upper bits of their hashes, of which the uppermost tell the part, and 32 the key in it.
PART_BITS = 11
_KEY_SHIFT = np.uint64(32 - PART_BITS)


@dataclass(frozen=True)
class Collocations:
    """`least`: how often a phrase has to occur; `absorbed`: percent of its occurrences in a longer candidate at which it
    is dropped; `first`: phrases per language; `modulus`, `longest`: of the parsing; `held`, `block`: counts of phrases, and
    hashes, that a task sums up before it passes them on; `bits`: of a place in the filter of hashes, at least 14; `parts`: of
    the ranking of a language."""

    least: int = 10
    absorbed: int = 50
    first: int = 2000
    modulus: int = 32
    longest: int = 256
    held: int = 1 << 16
    block: int = 1 << 19
    bits: int = 28
    parts: int = 64


def chunks(texts: list[bytes], settings: Collocations = Collocations()) -> list[bytes]:
    """The chunks of some texts, all in one list. In a chunk, words are parted by a space, pieces by a line feed."""
    tidy = []
    for text in texts:
        pieces = (piece.split() for piece in text.translate(_TABLE).split(b"\n"))
        tidy.append(b"\n".join([b" ".join(words) for words in pieces if words]))
    found = Texts(tidy, _SAME, _GAP)
    total = len(found.hashes)
    if not total:
        return []
    triggers = np.flatnonzero(shingles(found.hashes, 2) % np.uint64(settings.modulus) == 0)
    last = found.first[found.text + 1]
    triggers = triggers[triggers + 2 <= last[triggers]]
    cuts = np.unique(np.concatenate([found.first[:-1][np.diff(found.first) > 0], triggers]))
    gaps = np.diff(cuts, append=total)
    if gaps.max() > settings.longest:
        more = [np.arange(c + settings.longest, c + g - 1, settings.longest) for c, g in zip(cuts, gaps) if g > settings.longest + 1]
        cuts = np.unique(np.concatenate([cuts, *more]))
    ends = np.append(cuts[1:], total)
    closed = ends == last[cuts]  # no words of the text follow
    stops = found.ends[np.where(closed, ends, ends + 2) - 1]
    data = found.data
    return [data[a:b] + _END if c else data[a:b] for a, b, c in zip(found.starts[cuts].tolist(), stops.tolist(), closed.tolist())]


def _sent(counts: dict[str, Counter]) -> pa.RecordBatch:
    langs = pa.array([lang for lang, own in counts.items() for _ in own], pa.string())
    phrases = pa.array([p for own in counts.values() for p in own], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [langs, phrases, pa.array([n for own in counts.values() for n in own.values()], pa.int64())], ["lang", "phrase", "times"])


def _summed(pairs: Iterator[tuple], held: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrases, their times or None for one each) as batches of summed counts."""
    counts, size = defaultdict(Counter), 0
    for lang, phrases, times in pairs:
        own = counts[lang]
        size -= len(own)
        if times is None:
            own.update(phrases)
        else:
            get = own.get
            for phrase, n in zip(phrases, times):
                own[phrase] = get(phrase, 0) + n
        size += len(own)
        if size >= held:
            yield _sent(counts)
            counts, size = defaultdict(Counter), 0
    yield _sent(counts)


def dictionary(docs: DataFrame, settings: Collocations = Collocations(), lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """Rows (lang, phrase, times): the distinct chunks of a language, and how often they occur."""

    def parsed(batches):
        for rows in rows_of(batches):
            for group in grouped(rows, 1):
                for lang in dict.fromkeys(r[0] for r in group):
                    yield lang, chunks([r[1] for r in group if r[0] == lang], settings), None

    narrow = docs.select(F.coalesce(docs[lang_column].cast("string"), F.lit("und")).alias("lang"),
                         F.coalesce(docs[text_column], F.lit("")).cast("binary").alias("text"))
    each = narrow.mapInArrow(lambda batches: _summed(parsed(batches), settings.held), COUNTS)
    return each.groupBy("lang", "phrase").agg(F.sum("times").alias("times"))


class _Chunks:
    """The words of some chunks of one language: which are their own, not of the overlap, how often each
    occurs, and after which a piece ends."""

    def __init__(self, rows: list[tuple]):
        self.texts = t = Texts([r[1] for r in rows], _SAME, _GAP)
        closed = np.array([r[1].endswith(_END) for r in rows], bool)
        own = np.diff(t.first) - np.where(closed, 0, 2)
        place = np.arange(len(t.hashes)) - t.first[t.text]
        self.own = place < own[t.text]
        self.times = np.array([r[2] for r in rows], np.int64)[t.text]
        raw = np.frombuffer(t.data + b"\n", np.uint8)
        self.closes = raw[t.ends] == 10

    def keys(self, lang: str, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The words at which phrases of so many words begin, and the keys of these phrases."""
        n = max(len(self.own) - words + 1, 0)
        inside = self.own[:n].copy()
        for k in range(words - 1):
            inside &= ~self.closes[k : n + k]
        return np.flatnonzero(inside), mixed(shingles(self.texts.hashes, words)[inside] ^ _salt(lang)) >> _KEY_SHIFT

    def phrases(self, lang: str, chosen: np.ndarray, words: int) -> Iterator[tuple]:
        """(lang, phrases, times) for the phrases of so many words that begin at the chosen words. Those of chunks that
        occur once, which are most, go without times and are counted faster."""
        t, data, often = self.texts, self.texts.data, self.times[chosen] > 1
        for part, times in ((chosen[~often], None), (chosen[often], self.times[chosen[often]].tolist())):
            spans = zip(t.starts[part].tolist(), t.ends[part + words - 1].tolist())
            yield lang, [data[a:b] for a, b in spans], times


def _of_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Chunks]]:
    for rows in rows_of(batches, 4096):
        for lang in dict.fromkeys(r[0] for r in rows):
            for group in grouped((r for r in rows if r[0] == lang), 1):
                yield lang, _Chunks(group)


def _chunk_rows(found: DataFrame) -> DataFrame:
    return found.select("lang", F.col("phrase").cast("binary").alias("phrase"), "times")


@cache
def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _dealt(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Distinct keys in order and their times: a row for each part that has some."""
    bounds = np.searchsorted(keys, np.arange((1 << PART_BITS) + 1, dtype=np.uint64) << np.uint64(32))
    parts = np.flatnonzero(np.diff(bounds))
    offsets = bounds[np.append(parts, len(bounds) - 1)]
    columns = [pa.array(parts, pa.int32())]
    for values in (keys.astype(np.uint32), times):
        places = (offsets * values.itemsize).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(places), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(columns, ["part", "keys", "times"])


def likely(found: DataFrame, settings: Collocations) -> DataFrame:
    """Rows (part, bits): which keys occur often enough in the dictionary, among them those of all phrases that do, as a bit for
    each value of their upper bits."""
    least = min(max(settings.least, 1), 1 << 31)
    kind = np.min_scalar_type(least)

    def summed(once, often):
        keys, times = np.unique(np.concatenate(once), return_counts=True)
        yield _dealt(keys, np.minimum(times, least).astype(kind))
        keys, times = (np.concatenate(part) for part in zip(*often))
        order = np.argsort(keys)
        keys, first = np.unique(keys[order], return_index=True)
        if len(keys):
            yield _dealt(keys, np.minimum(np.add.reduceat(times[order], first), least).astype(kind))

    def run(batches):
        once, often, size = [], [], 0
        for lang, part in _of_languages(batches):
            for words in (1, 2, 3):
                places, keys = part.keys(lang, words)
                times = part.times[places]
                several = times > 1
                once.append(keys[~several])
                often.append((keys[several], times[several]))
                size += len(keys)
            if size >= settings.block:
                yield from summed(once, often)
                once, often, size = [], [], 0
        if size:
            yield from summed(once, often)

    def frequent(own: pa.Table) -> pa.Table:
        """The bits of one part. Times were cut at `least`, beyond which they make no difference."""
        keys, times = (np.frombuffer(b"".join(own[c].to_pylist()), t).astype(np.uint64) for c, t in (("keys", np.uint32), ("times", kind)))
        both = np.sort((keys << np.uint64(32)) | times)
        keys, first = np.unique(both >> np.uint64(32), return_index=True)
        enough = keys[np.add.reduceat(both & np.uint64(0xFFFFFFFF), first) >= least]
        bits = np.zeros(1 << (settings.bits - PART_BITS), bool)
        bits[(enough >> _slot_shift(settings)).astype(np.int64)] = True
        return pa.table({"part": own["part"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    each = _chunk_rows(found).mapInArrow(run, "part int, keys binary, times binary")
    return each.groupBy("part").applyInArrow(frequent, "part int, bits binary")


def _slot_shift(settings: Collocations) -> np.uint64:
    return np.uint64(PART_BITS + 32 - settings.bits)


def _filter(found: DataFrame, settings: Collocations) -> bytes:
    """The bits of all parts: as many however large the input is."""
    rows = likely(found, settings).toArrow()
    out = np.zeros((1 << PART_BITS, 1 << (settings.bits - PART_BITS - 3)), np.uint8)
    for part, bits in zip(rows["part"].to_pylist(), rows["bits"].to_pylist()):
        out[part] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


def passed(found: DataFrame, settings: Collocations) -> DataFrame:
    """Rows (lang, phrase, times), several for a phrase: the phrases of up to three words whose keys are likely, and all words
    of a language together, with an empty phrase."""
    bits = found.sparkSession.sparkContext.broadcast(_filter(found, settings))

    def run(batches):
        useful = np.frombuffer(bits.value, np.uint8)
        for lang, part in _of_languages(batches):
            yield lang, [b""], [int(part.times[part.own].sum())]
            for words in (1, 2, 3):
                places, keys = part.keys(lang, words)
                yield from part.phrases(lang, places[passing(keys >> _slot_shift(settings), useful)], words)

    return _chunk_rows(found).mapInArrow(lambda batches: _summed(run(batches), settings.held), COUNTS)


def phrases(found: DataFrame, settings: Collocations) -> DataFrame:
    """Rows (lang, phrase, times) for the phrases of up to three words that occur often enough, and for all words of a language
    together, with an empty phrase, counted in the dictionary."""
    return passed(found, settings).groupBy("lang", "phrase").agg(F.sum("times").alias("times")).where(F.col("times") >= settings.least)


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exactly, for counts of up to 16 digits."""
    a, l, r = (x.cast("decimal(19,0)") for x in (a, l, r))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)


def _words(phrase: str, start: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def collocations(docs: DataFrame, settings: Collocations = Collocations(), lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the best phrases of every language."""
    found = stored(dictionary(docs, settings, lang_column, text_column), "dictionary", compression="zstd")
    frequent = stored(phrases(found, settings), "frequent")
    two, three = (frequent.where(F.size(F.split("phrase", " ")) == n) for n in (2, 3))
    inside = three.select("lang", F.explode(F.array(_words("phrase", 1, 2), _words("phrase", 2, 2))).alias("phrase"), "times")
    longer = inside.groupBy("lang", "phrase").agg(F.max("times").alias("longer"))
    left = two.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < settings.absorbed * F.col("times"))).drop("longer")

    def cuts(rows: DataFrame, *places: int) -> DataFrame:
        each = [F.struct(F.lit(k).alias("k"), _words("phrase", 1, k).alias("head"), _words("phrase", k + 1, 2).alias("rest")) for k in places]
        return rows.select("lang", "phrase", F.col("times").alias("a"), F.inline(F.array(*each)))

    def part(name: str, count: str) -> DataFrame:
        return frequent.select("lang", F.col("phrase").alias(name), F.col("times").alias(count))

    rated = (
        cuts(left, 1).unionByName(cuts(three, 1, 2))
        .join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
        .select("lang", "phrase", "a", F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut")))
    lowest = rated.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = first_of_each(lowest, ["lang"], order, settings.first, parts=settings.parts)
    return best.join(part("nothing", "n").where("nothing = ''"), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
