"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Each rule is a measure of a text that is high in poor ones, with a fixed ladder of cutoffs from lenient to
strict. Labelled good documents of a holdout test, for each stratum and rule, the hypotheses "this
cutoff rejects more than `alpha / rules` of the good documents": the exact binomial probability of
seeing no more rejections than were seen has to be at most `delta / (strata * rules)`. Along a
ladder the tests run from lenient to strict and end at the first that fails (fixed-sequence
testing), over ladders they are corrected by Bonferroni. So with probability 1 - delta, all rules
together reject at most `alpha` of the good documents in every stratum. Among the certified cutoffs, the
labelled rest (the tuning part) picks the one with the best balance of poor documents caught
against good ones lost; a rule that catches nothing there is not used.

Everything is DataFrame expressions. Statistics are sums over all documents that have labels; only the
chosen cutoffs, at most `max_strata` times the rules, reach the driver.

Defined results: a null or blank text has no words, so it fails the base rules; a null stratum or one
without certified cutoffs rejects nothing beyond the base rules; labels are merged by document (a
document is good if all its labels say so) and null labels are ignored; with empty tables nothing is
certified; repeated rows count as rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedrank.llm.common import WORD, words

#: What counts in a text, in the order in which `measured` returns it.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
WINDOW = 5

#: For each rule its measure and its cutoffs, lenient to strict.
LADDERS = {
    "symbol_ratio": (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_ratio": (0.19, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06),
    "upper_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "mean_word": (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0),
}


@dataclass(frozen=True)
class Risk:
    """`alpha`: share of a stratum's good documents that may be rejected; `delta`: probability that the
    guarantee fails; `loss`: how many times a lost good document weighs a caught poor one."""

    alpha: float = 0.02
    delta: float = 0.05
    loss: float = 20.0
    max_strata: int = 2000
    ladders: dict = field(default_factory=lambda: LADDERS)


def measured(docs: DataFrame, text_column: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns `keep`, by default doc_id and lang, and the MEASURES of the whole text, as longs."""
    kept = keep or {"doc_id": docs["doc_id"], "lang": docs["lang"]}
    text, keep = F.coalesce(docs[text_column], F.lit("")), list(kept)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    cut = docs.select(
        *(c.alias(name) for name, c in kept.items()), text.alias("__t"), words(text).alias("__w"), lines.alias("__l"))
    starts = F.slice("__w", 1, F.greatest(F.size("__w") - (WINDOW - 1), F.lit(0)))

    def window_hash(word: Column, i: Column) -> Column:
        return F.xxhash64(word, *(F.get("__w", i + k) for k in range(1, WINDOW)))

    hashed = cut.select(
        *keep, "__w", F.transform(starts, window_hash).alias("__h"),
        F.size("__w").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        F.regexp_count("__t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    # Different hashes prove different windows; only where some are equal the windows are compared themselves.
    rest = [c for c in MEASURES if c != "n_repeat_words"]
    ordered = F.sort_array(F.transform(
        "__h", lambda _, i: F.struct(F.array_join(F.slice("__w", i + 1, WINDOW), " ").alias("s"), i.alias("i"))))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    sorted_ = hashed.select(*keep, *rest, F.when(repeats, ordered).alias("__s"))

    def repeated(e: Column, j: Column) -> Column:
        return (e["s"] == F.get("__s", j - 1)["s"]) | (e["s"] == F.get("__s", j + 1)["s"])

    places = sorted_.select(
        *keep, *rest, F.sort_array(F.transform(F.filter("__s", repeated), lambda e: e["i"])).alias("__p"))
    covered = F.aggregate(
        F.transform("__p", lambda p, k: F.least(F.coalesce(F.get("__p", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    return places.select(*keep, *(
        F.coalesce(covered, F.lit(0)).cast("long").alias(c) if c == "n_repeat_words" else F.col(c) for c in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """The measure of each rule; 0 for texts without words."""

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole)).otherwise(F.lit(0.0))

    return {
        "symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "upper_ratio": ratio("n_upper", "word_chars"),
        "mean_word": ratio("word_chars", "n_words"),
    }


def _log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def at_most(k: Column, n: Column, p: float) -> Column:
    """The probability of at most `k` successes in `n` trials of probability 0 < p < 1, summed term by term
    in logarithms. Where k is above n * p it is large anyway, and 1 is returned."""
    step = F.log(F.lit(p / (1 - p)))
    first = n * F.log1p(F.lit(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def following(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1).cast("double") / i) + step
        return F.struct(term.alias("term"), _log_add(state["sum"], term).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    tail = F.aggregate(terms, start, following, lambda state: F.least(F.exp(state["sum"]), F.lit(1.0)))
    return F.when(k.cast("double") > n * F.lit(p), F.lit(1.0)).otherwise(tail)


def choose_cutoffs(measures: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """Rows (stratum, rule, cutoff). `measures` as `measured` returns them, with doc_id; `labels` has
    (doc_id, quality). A quarter of the labelled documents, by a hash of their id, tunes; the rest is the holdout."""
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    holdout = ~F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1", "2", "3")
    values = rule_values()

    def level(rule: str) -> Column:
        """The first step of the ladder, from 1, that rejects the value; one more than there are if none does."""
        ladder = F.array(*(F.lit(c) for c in risk.ladders[rule]))
        spared = F.size(F.filter(ladder, lambda c: values[rule] <= c))
        return F.struct(F.lit(rule).alias("rule"), (spared + 1).alias("level"))

    labelled = (
        measures.where(~base_failed()).select("doc_id", F.col(stratum).alias("stratum"), *MEASURES)
        .join(good, "doc_id").where(F.col("stratum").isNotNull())
        .select("stratum", "good", holdout.alias("holdout"), F.explode(F.array(*map(level, risk.ladders))).alias("r"))
        .groupBy("stratum", "good", "holdout", "r.rule", "r.level").count()
    )
    counts = labelled.groupBy("stratum", "rule", "level").agg(*(
        F.coalesce(F.sum(F.when((F.col("good") == g) & (F.col("holdout") == h), F.col("count"))), F.lit(0)).alias(name)
        for name, g, h in (("good_held", True, True), ("good_tuned", True, False), ("poor_tuned", False, False))))
    # A step rejects what the steps before it reject, and more.
    sequence = Window.partitionBy("stratum", "rule")
    so_far = sequence.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    steps = _ladder_steps(counts, risk)
    curves = (
        steps.join(counts, ["stratum", "rule", "level"], "left").na.fill(0, ["good_held", "good_tuned", "poor_tuned"])
        .select("stratum", "rule", "level", "cutoff",
                *(F.sum(c).over(so_far).alias(f"{c}_out") for c in ("good_held", "good_tuned", "poor_tuned")),
                *(F.sum(c).over(sequence).alias(f"{c}_all") for c in ("good_held", "good_tuned", "poor_tuned")))
        .where(F.col("cutoff").isNotNull())
    )
    tests = steps.select("stratum", "rule").distinct().count() or 1
    tested = curves.withColumn(
        "p", at_most(F.col("good_held_out"), F.col("good_held_all"), risk.alpha / len(risk.ladders)))
    gain = (
        F.col("poor_tuned_out") / F.greatest("poor_tuned_all", F.lit(1))
        - F.lit(risk.loss) * F.col("good_tuned_out") / F.greatest("good_tuned_all", F.lit(1)))
    certified = tested.withColumn("worst", F.max("p").over(so_far)).where(F.col("worst") <= risk.delta / tests)
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "level")
    return (
        certified.withColumn("gain", gain).where(F.col("gain") > 0).withColumn("place", F.row_number().over(best))
        .where(F.col("place") == 1).select("stratum", "rule", "cutoff"))


def _ladder_steps(counts: DataFrame, risk: Risk) -> DataFrame:
    """Every (stratum, rule, level) with its cutoff, null for what no step rejects."""
    ladders = F.array(*(
        F.struct(F.lit(rule).alias("rule"), F.array(*(F.lit(c) for c in cutoffs), F.lit(None).cast("double")).alias("c"))
        for rule, cutoffs in risk.ladders.items()))
    return (
        counts.select("stratum").distinct().select("stratum", F.explode(ladders).alias("r"))
        .select("stratum", "r.rule", F.posexplode("r.c").alias("step", "cutoff"))
        .select("stratum", "rule", (F.col("step") + 1).alias("level"), "cutoff"))


def passes(cutoffs: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> Column:
    """True unless a base rule or a chosen cutoff of the row's stratum rejects it. The cutoffs are brought to
    the driver: at most `max_strata` strata, beyond which a coarser stratum has to be chosen."""
    limit = risk.max_strata * len(risk.ladders)
    rows = cutoffs.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {risk.max_strata} strata; choose a coarser one")
    rejected = base_failed()
    for rule, value in rule_values().items():
        own = [(r["stratum"], r["cutoff"]) for r in rows if r["rule"] == rule]
        if own:
            table = F.create_map(*(F.lit(x) for pair in own for x in pair))
            cutoff = F.when(F.col(stratum).isNotNull(), F.try_element_at(table, F.col(stratum)))
            rejected = rejected | F.coalesce(value > cutoff, F.lit(False))
    return ~rejected
