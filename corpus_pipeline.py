"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is to be written before the next stage
begins; all but the last return the columns of `documents`. What a stage stores for itself in the shared folder
is deleted when the next stage begins. The stages have no common form in SQL (trained models, packing), so
ORACLE_SQL is None; tests hold each stage against a brute-force version.

Defined results: as the operators define them. Near-dedup decides by rows: those that repeat a doc_id with other
texts are documents of their own, of rows that are equal in all columns one stays, and documents with a null
doc_id stay only where no other of their group has one.
"""

from __future__ import annotations

import threading
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedrank.llm import line_dedup, packing, quality_rules, simhash, toxicity
from feedrank.llm.common import ready, release, stored, stored_since

ORACLE_SQL = None


def _scratch() -> list[str]:
    """What the last stage of this thread has stored for itself."""
    return threading.current_thread().__dict__.setdefault("pipeline_scratch", [])


def _stage(step):
    """Delete what the stage before has stored for itself, and note what this one stores."""

    @wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(ready(spark), list(_scratch()))
        mark = len(stored_since(0))
        result = step(spark, docs, sf_dir)
        _scratch()[:] = stored_since(mark)
        return result

    return run_stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs of their language."""
    keep = {"__doc": F.struct(*docs.columns), "doc_id": docs["doc_id"], "lang": docs["lang"]}
    measures = stored(quality_rules.measured(docs, keep=keep), "measured")
    cutoffs = quality_rules.choose_cutoffs(measures, _labels(spark, sf_dir))
    return measures.where(quality_rules.passes(cutoffs)).select("__doc.*")


@_stage
def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    settings = toxicity.Toxicity()
    model = toxicity.fit(docs, _labels(spark, sf_dir), settings)
    return toxicity.without_toxic(docs, model, settings.threshold)


@_stage
def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that come earlier."""
    return line_dedup.without_repeats(docs)


@_stage
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row: that with the smallest doc_id, then fingerprint, then hashes."""
    settings = simhash.SimHash(shingle=3, max_bits=2)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = [F.xxhash64(*columns), F.hash(*columns)]  # tell rows of one id apart
    prints = stored(simhash.fingerprints(docs, settings.shingle, marks=row), "prints")
    found = simhash.groups(prints.select("doc_id", "bits"), settings).select("bits", "component")
    rows = stored(
        prints.groupBy("doc_id", "bits", "m0", "m1").agg(F.count(F.lit(1)).alias("times")).join(found, "bits"), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "bits", "m0", "m1")
    firsts = rows.groupBy("component").agg(F.min(key).alias("kept"))
    marked = rows.join(firsts, "component").select("doc_id", "m0", "m1", "times", (key != F.col("kept")).alias("gone"))

    def of(decided: DataFrame, how: str) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(decided["__d"]) & (row[0] == decided["__m0"]) & (row[1] == decided["__m1"])
        return docs.join(decided, same, how).select(*columns)

    names = [F.col("doc_id").alias("__d"), F.col("m0").alias("__m0"), F.col("m1").alias("__m1")]
    decided = stored(marked.where("gone OR times > 1").select(*names, "gone"), "decided")
    left = of(decided, "left_anti")
    copies = decided.where("NOT gone")
    if copies.isEmpty():
        return left
    return left.unionByName(of(copies, "left_semi").distinct())


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", harmless),
    ("line_dedup", fresh_lines),
    ("simhash_near_dedup", distinct),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        mark = len(stored_since(0))
        docs = stored(result, name)
        after = stored_since(mark)
        release(spark, before)
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
