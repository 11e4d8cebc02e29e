"""Toxicity by two class-conditional Kneser-Ney models of words.

The models of toxic and of ordinary text give each word a probability after the word before it. They have three
levels: pairs of words and words, counted by class as the number of documents that hold them, so that a document that repeats
itself counts once; and below, shared by both classes, words by the number of different words they follow in either. Every
level is discounted, and what that leaves is given out by the level below it.

A class keeps a probability of its own only as far as its counts tell: with G2 the likelihood-ratio statistic of the two counts
of an expression against what the level below expects of them, it is trusted by 1 - (`doubt`² / G2), the rest is that of the
level below, and so is all of it where G2 is smaller. A word is also trusted by 1 - (`margin` / |log-ratio|), since counts of large
corpora tell small differences of no use. A pair that only one document holds is not trusted. So expressions too rare or too much alike
in both classes get the shared probability in both.

A text's raw score is its log-likelihood per word in the toxic model less that in the ordinary model, over the whole text, with what speaks
for either class. A logistic curve, fitted on labelled rows that the models have not seen, turns it into a score from 0 to 1.

Labelled rows are used by the hash of their id modulo 4: 0 and 1 for the models, 3 for the curve, 2 (held
out) for nothing. All labelled documents of folds 0 and 1 are counted. The curve has two parameters and is fitted on up to
`most_labels` documents of fold 3, by another hash of the id, all if there are no more. The models reach the
tasks as sorted parts of about `slots` trusted expressions, of which a task holds one at a time, behind a bitmap of fixed size that
spares most others the search.

Defined results: null and blank texts, and texts without words, have raw score 0; a document with several labels is
toxic if one says so; null labels are ignored; without labels of both classes every score is 0; repeated
rows are scored each for itself, and count each for itself where labelled; texts of any length are scored whole; an empty table
gives no rows; extra columns, whatever their names, are left as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedrank.llm import kneser_ney as kn
from feedrank.llm import lookup
from feedrank.llm.common import release, rows_of, stored, stored_since
from feedrank.operators.bitmaps import bitmap, passing

_WORD = re.compile(r"\w+")
#: Bits of the hash of a word, and of a pair.
WORD_BITS = 63
#: In place of the word before: the row counts documents with the word itself.
ALONE = -1
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Toxicity:
    """`doubt`, `pair_doubt`: standard errors that the counts of words and of pairs have to exceed; `margin`: of the log-ratio
    of words; `bins`: of the histogram that the curve is fitted on; `most_labels`: labelled documents that it is fitted on (16
    bytes each); `slots`: expressions that are broadcast at a time (12 bytes each); `threshold`: from which score on a text
    is taken as toxic."""

    doubt: float = 3.0
    pair_doubt: float = 4.0
    margin: float = 0.5
    slots: int = 1 << 21
    bins: int = 4096
    most_labels: int = 1 << 20
    threshold: float = 0.3


def fold_of(doc_id: Column) -> Column:
    """The hash of an id as text, modulo 4; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def hashed(text: str | None) -> np.ndarray:
    """A 63-bit hash of each word of a text, in order."""
    words = _WORD.findall((text or "").lower())
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words)) >> np.uint64(64 - WORD_BITS)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each pair of words."""
    mixed = (before + np.uint64(1)) * _MIX ^ word
    mixed ^= mixed >> np.uint64(29)
    return (mixed * _MIX) >> np.uint64(64 - WORD_BITS)


def expressions(text: str | None):
    """The keys of a text's words, and of each word with the one before it: as many."""
    word = hashed(text)
    return [word, pair_keys(_before(word), word)]


def _before(word: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), word])[: len(word)]


@dataclass
class Model:
    trusted: lookup.Tables  # log-ratio of each trusted word, and what each trusted pair adds to that of its word
    slope: float
    shift: float
    likely: bytes  # a bitmap that all trusted keys pass

    def values(self, keys: np.ndarray) -> np.ndarray:
        return lookup.found(self.trusted.pieces(), keys)[1]


def known_labels(labels: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (id, class, fold), class 1 for toxic: all documents with a label, or about `most` of them by a hash."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") == 1).cast("int").alias("class"))
    if most is not None and (total := known.count()) > most:
        share = F.lit(int(most / total * (1 << 30)))
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
    return known.withColumn("fold", fold_of(F.col("id")))


def held(texts: DataFrame, flush: int = 1 << 22) -> DataFrame:
    """Rows (word, before, n0, n1) of `texts` (class, text): how many documents of each class hold a word after another, and, with
    ALONE before it, the word. A task adds up what it has read, and passes it on before that gets large."""

    def run(batches):
        waiting, size = [], 0

        def emit() -> pa.RecordBatch:
            word, before, class_ = (np.concatenate(c) for c in zip(*waiting))
            word, before, counts = _summed(word, before, class_)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (word, before, *counts)], ["word", "before", "n0", "n1"])

        for rows in rows_of(batches):
            for class_, text in rows:
                word = hashed(text)
                if not len(word):
                    continue
                before, distinct = _before(word), np.unique(word)
                _, place = np.unique(pair_keys(before, word), return_index=True)
                own = np.concatenate([word[place], distinct]).view(np.int64)
                last = np.concatenate([before[place].view(np.int64), np.full(len(distinct), ALONE, np.int64)])
                waiting.append((own, last, np.full(len(own), class_, np.int8)))
                size += len(own)
                if size >= flush:
                    yield emit()
                    waiting, size = [], 0
        if waiting:
            yield emit()

    return texts.mapInArrow(run, "word long, before long, n0 int, n1 int")


def _summed(word: np.ndarray, before: np.ndarray, class_: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    order = np.lexsort((before, word))
    word, before, class_ = word[order], before[order], class_[order]
    starts = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (before[1:] != before[:-1])]))
    ones = np.add.reduceat(class_, starts, dtype=np.int32)
    size = np.diff(np.append(starts, len(word))).astype(np.int32)
    return word[starts], before[starts], [size - ones, ones]


def counted(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """From rows (class, text): words (word, n0, n1, k) with the documents of each class and the number of different words they
    follow in both; contexts (before, n0, n1, t0, t1) with the sums of their pairs and the number of different ones in each
    class; pairs (word, before, n0, n1) of several documents; and the discounts of pairs. One shuffle of pairs serves them all."""
    pairs = held(texts).groupBy("word", "before").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n, zero = [F.col("n0"), F.col("n1")], F.lit(0).cast("long")
    alone = F.col("before") == ALONE

    def part(kind: int, rows: DataFrame, **columns: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), *(columns.get(c, zero).cast("long").alias(c) for c in ("word", "before", "n0", "n1", "t0", "t1")))

    # No filter on the keys here: it would be pushed below the shuffle, which then could not be shared.
    words = pairs.groupBy("word").agg(*(F.sum(F.when(alone, c)).alias(f"n{i}") for i, c in enumerate(n)), F.count_if(~alone).alias("t0"))
    contexts = pairs.groupBy("before").agg(
        *(F.sum(c).alias(f"n{i}") for i, c in enumerate(n)), *(F.count_if(c > 0).alias(f"t{i}") for i, c in enumerate(n)))
    repeated = pairs.where(F.least(F.col("before"), n[0] + n[1] - 2) >= 0)
    rare = pairs.agg(*(F.count_if((c == times) & ~alone).alias(f"{'nt'[times - 1]}{i}") for i, c in enumerate(n) for times in (1, 2)))
    of = {c: F.col(c) for c in ("word", "before", "n0", "n1", "t0", "t1")}

    def some(*names: str) -> dict[str, Column]:
        return {c: of[c] for c in names}

    both = ("n0", "n1", "t0", "t1")
    everything = stored(
        part(0, words, **some("word", "n0", "n1", "t0")).unionByName(part(1, contexts, **some("before", *both)))
        .unionByName(part(2, repeated, **some("word", "before", "n0", "n1"))).unionByName(part(3, rare, **some(*both))), "counts")
    once = everything.where("kind = 3").first()
    discounts = tuple(_discount(once[f"n{c}"], once[f"t{c}"]) for c in (0, 1))
    return (everything.where("kind = 0").select("word", "n0", "n1", F.col("t0").alias("k")),
            everything.where(f"kind = 1 AND before <> {ALONE}").select("before", *both),
            everything.where("kind = 2").select("word", "before", "n0", "n1"), discounts)


def _among(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `docs` (doc_id) that may be in `known` (id), by a filter of fixed size; only ids are sent to Python."""
    bits = np.frombuffer(bitmap(known.select(F.xxhash64("id").alias("h")), "h"), np.uint8)

    @F.pandas_udf("boolean")
    def likely(h: pd.Series) -> pd.Series:
        return pd.Series(passing(h.to_numpy().view(np.uint64), bits))

    return docs.where(likely(F.xxhash64("doc_id")))


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


def _trust(n0: Column, n1: Column, share: Column, doubt: float) -> Column:
    """What is trusted of two counts where `share` of them are expected in class 1."""

    def term(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / ((n0 + n1) * expected))).otherwise(F.lit(0.0))

    statistic = 2 * (term(n1, share) + term(n0, 1 - share))
    return F.when(statistic > doubt * doubt, 1 - F.lit(doubt * doubt) / statistic).otherwise(F.lit(0.0))


def word_model(words: DataFrame, settings: Toxicity) -> DataFrame | None:
    """`words` with the probabilities q0 and q1 of both models; None if a class has no text."""
    columns = ("n0", "n1", "k")
    discount = {c: kn.discounts(words, c) for c in columns}
    taken = {c: kn.taken(F.col(c), discount[c]) for c in columns}
    sums = words.agg(F.count(F.lit(1)).alias("words"), *(F.sum(c).alias(c) for c in columns),
                     *(F.sum(t).alias(f"t_{c}") for c, t in taken.items())).first()
    if not sums["n0"] or not sums["n1"]:
        return None

    def share(c: str, below: Column) -> Column:
        return (F.col(c) - taken[c]) / F.lit(float(sums[c])) + F.lit(sums[f"t_{c}"] / sums[c]) * below

    rows = words.withColumn("shared", share("k", F.lit(1 / sums["words"])))
    rows = rows.withColumn("p0", share("n0", F.col("shared"))).withColumn("p1", share("n1", F.col("shared")))
    differ = F.abs(F.log(F.col("p1") / F.col("p0")))
    expected = F.lit(sums["n1"] / (sums["n0"] + sums["n1"]))
    large = F.when(differ > settings.margin, 1 - F.lit(settings.margin) / differ).otherwise(F.lit(0.0))
    trust = _trust(F.col("n0"), F.col("n1"), expected, settings.doubt) * large
    rows = rows.withColumn("trust", trust)
    mixed = (F.col("trust") * F.col(f"p{c}") + (1 - F.col("trust")) * F.col("shared") for c in (0, 1))
    return rows.select("word", "trust", *(m.alias(f"q{c}") for c, m in enumerate(mixed)))


def pair_model(pairs: DataFrame, contexts: DataFrame, words: DataFrame, discounts: tuple[float, float], settings: Toxicity) -> DataFrame:
    """Rows (before, word, value) of trusted pairs: what they add to the log-ratio of their word."""
    sums = contexts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    likely = [F.lit(float(sums[f"n{c}"])) * F.col(f"q{c}") for c in (0, 1)]
    trust = _trust(F.col("n0"), F.col("n1"), likely[1] / (likely[0] + likely[1]), settings.pair_doubt)
    told = pairs.join(words.select("word", "q0", "q1"), "word").withColumn("trust", trust).where("trust > 0")
    after = contexts.select("before", *(F.col(f"{x}{c}").alias(f"{x}_{c}") for x in "nt" for c in (0, 1)))
    rows = told.join(after, "before")

    def mixed(c: int) -> Column:
        own = (F.greatest(F.col(f"n{c}") - discounts[c], F.lit(0.0)) + discounts[c] * F.col(f"t_{c}") * F.col(f"q{c}")) / F.col(f"n_{c}")
        known = F.when(F.col(f"n_{c}") > 0, own).otherwise(F.col(f"q{c}"))
        return F.col("trust") * known + (1 - F.col("trust")) * F.col(f"q{c}")

    return rows.select("before", "word", (F.log(mixed(1) / mixed(0)) - F.log(F.col("q1") / F.col("q0"))).alias("value"))


def _keyed(pairs: DataFrame) -> DataFrame:
    """Rows (key, value) of rows (before, word, value)."""

    def run(batches):
        for batch in batches:
            before, word = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(before, word).view(np.int64)), batch.column(2)], ["key", "value"])

    return pairs.mapInArrow(run, "key long, value double")


def trusted(texts: DataFrame, settings: Toxicity) -> DataFrame | None:
    """Rows (key, value) of what the models of `texts` (class, text) trust; None if a class has no text."""
    words, contexts, pairs, discounts = counted(texts)
    model = word_model(words, settings)
    if model is None:
        return None
    single = model.where("trust > 0").select(F.col("word").alias("key"), F.log(F.col("q1") / F.col("q0")).alias("value"))
    return single.unionByName(_keyed(pair_model(pairs, contexts, model, discounts, settings)))


def fit(docs: DataFrame, labels: DataFrame, settings: Toxicity = Toxicity(), id_column: str = "doc_id",
        text_column: str = "text") -> Model:
    """Both models and the curve."""
    spark, mark = docs.sparkSession, len(stored_since(0))
    known = stored(known_labels(labels), "known")
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    same = F.col("doc_id") == F.col("id")
    teachers = known.where("fold < 2")
    # Always by a shuffle, since the labels grow with the documents; of a filter of fixed size, what it lets pass is joined.
    likely = _among(narrow.where(fold_of(F.col("doc_id")) < 2), teachers)
    taught = likely.join(teachers.hint("merge"), same)
    found = trusted(taught.select("class", "text"), settings)
    none = known.limit(0).select(F.col("id").alias("key"), F.lit(0.0).alias("value"))
    entries = stored((none if found is None else found).select(F.lit(0).alias("table"), "key", "value"), "trusted")
    model = Model(lookup.tables(entries, settings.slots), 0.0, -np.inf, bitmap(entries, "key"))
    if found is not None:
        sample = stored(known_labels(labels.where(fold_of(F.col("doc_id").cast("long")) == 3), settings.most_labels), "sample")
        unseen, raw = _raw(narrow.join(F.broadcast(sample), same).select("class", "text"), model)
        tests = stored(unseen.select(raw.alias("raw"), "class"), "raw")
        model.slope, model.shift = curve(tests, settings.bins)
    release(spark, stored_since(mark))
    return model


def _raw(docs: DataFrame, model: Model, text_column: str = "text") -> tuple[DataFrame, Column]:
    """`docs` with what the difference of their log-likelihoods per word is computed from, and that."""
    rows, mean = lookup.scored(docs, expressions, model.values, text_column, model.likely)
    return rows, 2 * mean  # two keys a word


def curve(tests: DataFrame, bins: int) -> tuple[float, float]:
    """Slope and shift of the logistic curve for rows (raw, class), fitted on a histogram of `bins`."""
    ends = tests.agg(F.min("raw").alias("a"), F.max("raw").alias("b")).first()
    if ends["a"] is None:
        return 0.0, -np.inf
    width = max(ends["b"] - ends["a"], 1e-9) / bins
    rows = tests.groupBy(F.least(F.floor((F.col("raw") - ends["a"]) / width), F.lit(bins - 1)).alias("bin")).agg(
        F.sum("class").alias("ones"), F.count(F.lit(1)).alias("all")).toPandas()
    x = ends["a"] + (rows["bin"].to_numpy(float) + 0.5) * width
    ones, count = rows["ones"].to_numpy(float), rows["all"].to_numpy(float)
    if not 0 < ones.sum() < count.sum():
        return 0.0, -np.inf
    scale = float(np.sqrt(np.average((x - np.average(x, weights=count)) ** 2, weights=count))) or 1.0
    design = np.stack([np.ones_like(x), x / scale], axis=1)
    w = np.array([np.log(ones.sum() / (count.sum() - ones.sum())), 0.0])
    prior = np.diag([1e-3, 1e-2])
    for _ in range(100):  # Newton steps with a weak prior, so that separable classes end
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (ones - count * p) - prior @ w
        step = np.linalg.solve((design.T * (count * p * (1 - p))) @ design + prior, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[1] / scale), float(w[0])


def _score(model: Model, raw: Column) -> Column:
    if np.isinf(model.shift):
        return F.lit(0.0)
    value = F.lit(model.shift) + F.lit(model.slope) * raw
    return 1 / (1 + F.exp(-F.greatest(F.least(value, F.lit(500.0)), F.lit(-500.0))))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, raw, score)."""
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    rows, raw = _raw(narrow, model)
    return rows.select("doc_id", raw.alias("raw"), _score(model, raw).alias("score"))


def without_toxic(docs: DataFrame, model: Model, threshold: float, text_column: str = "text") -> DataFrame:
    """The rows of `docs` whose score is below `threshold`."""
    rows, raw = _raw(docs, model, text_column)
    return rows.where(_score(model, raw) < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
