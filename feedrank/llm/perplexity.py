"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

N-grams of bytes are counted over all trusted texts and estimated order by order as joins of Spark tables
that are sharded by n-gram. For scoring all estimates are broadcast in sorted parts of bounded size, of which a task holds
one at a time, so each document's perplexity is computed where it is read, and is that of the whole model. A document passes if its perplexity is at most
a quantile of its language's trusted texts that the model has not seen; every language has its own.

Defined results: null and blank texts have the perplexity of one space; a text whose language has no
threshold (or is null) passes; without trusted texts every perplexity is 256 and all pass; repeated rows
count as rows; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedrank.llm import kneser_ney as kn
from feedrank.llm import lookup
from feedrank.llm.common import release, stored, stored_since


@dataclass(frozen=True)
class Perplexity:
    """`quantile` of unseen trusted perplexities that still passes; `slots`: n-grams that are broadcast, and held by a
    task, at a time (12 bytes each)."""

    order: int = 5
    slots: int = 1 << 21
    quantile: float = 0.99
    accuracy: int = 10_000
    most_languages: int = 10_000


@dataclass
class Model:
    """`tables` in the order in which backing off needs them: from the longest n-grams to bytes, the log probabilities by
    n-gram and then by context the log of what it leaves to shorter ones."""

    order: int
    tables: lookup.Tables

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """The log probability of the last byte of each n-gram of `order` bytes."""
        open_, value = np.arange(len(keys)), np.zeros(len(keys))
        for table, pieces in groupby(self.tables.pieces(), lambda piece: piece[0]):
            k = self.order - table // 2
            short = keys[open_] & np.uint64((1 << 8 * k) - 1)
            known, log = lookup.found(pieces, short >> np.uint64(8) if table % 2 else short)
            value[open_] += log
            if table % 2 == 0:
                open_ = open_[~known]
        value[open_] -= np.log(256)
        return value


def fit(trusted: DataFrame, settings: Perplexity = Perplexity(), text_column: str = "text") -> Model:
    """The model of all rows of `trusted`."""
    spark, mark, order = trusted.sparkSession, len(stored_since(0)), settings.order
    top = stored(kn.counted(trusted.select(trusted[text_column].alias("text")), order), "counts")
    tables = kn.continuation(top.select("key"), order - 1)
    tables.append(stored(kn.interpolated(top, order, tables[-1] if tables else None), f"order{order}"))
    entries = []
    for k, table in enumerate(tables, 1):
        contexts = table.groupBy("context").agg(F.first("gamma").alias("gamma"))
        at = 2 * (order - k)
        entries.append(table.select(F.lit(at).alias("table"), "key", F.log("p").alias("value")))
        entries.append(contexts.select(F.lit(at + 1).alias("table"), F.col("context").alias("key"), F.log("gamma").alias("value")))
    found = lookup.tables(reduce(DataFrame.unionByName, entries), settings.slots)
    release(spark, stored_since(mark))
    return Model(order, found)


def perplexities(docs: DataFrame, model: Model, text_column: str = "text", out: str = "perplexity") -> DataFrame:
    """`docs` without the text and with the perplexity per byte of the whole text as `out`."""
    order = model.order
    rows, mean = lookup.scored(docs, lambda text: kn.keys(kn.prepared(text, order), order), model.logs, text_column)
    kept = (F.col(f"`{c}`") for c in docs.columns if c not in (text_column, out))
    return rows.select(*kept, F.exp(-mean).alias(out))


def thresholds(scored: DataFrame, settings: Perplexity = Perplexity()) -> DataFrame:
    """Rows (lang, threshold) from rows (lang, perplexity) of trusted texts that the model has not seen."""
    quantile = F.percentile_approx("perplexity", settings.quantile, settings.accuracy)
    return scored.where("lang IS NOT NULL").groupBy("lang").agg(quantile.alias("threshold"))


def passes(limits: DataFrame, settings: Perplexity = Perplexity()):
    """Whether a row (lang, perplexity) passes, as a column. Brings at most `most_languages` thresholds to the driver."""
    rows = limits.limit(settings.most_languages + 1).collect()
    if len(rows) > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} languages")
    if not rows:
        return F.lit(True)
    table = F.create_map(*(F.lit(x) for r in rows for x in (r["lang"], r["threshold"])))
    limit = F.when(F.col("lang").isNotNull(), F.try_element_at(table, F.col("lang")))
    return F.coalesce(F.col("perplexity") <= limit, F.lit(True))
