"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedrank.llm import (
    bpe, collocations, decontamination, hard_negatives, language_id, line_dedup, packing, perplexity, quality_rules, simhash, sketches, token_shards, toxicity,
)
from feedrank.llm.oracle import ORACLES  # noqa: F401  registered with QUERIES
from feedrank.llm.common import ready, release, shared_folder, stored, stored_since, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = simhash.SimHash(shingle=3, max_bits=2)
    prints = stored(simhash.fingerprints(table(spark, sf_dir, "documents"), settings.shingle), "prints")
    return simhash.near_duplicates(prints, settings).select(
        "doc_id", simhash.hexadecimal("bits").alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = stored(quality_rules.measured(table(spark, sf_dir, "documents")), "measures")
    cutoffs = quality_rules.choose_cutoffs(measures, table(spark, sf_dir, "labels"))
    return measures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.base_failed().alias("base_failed"), quality_rules.passes(cutoffs).alias("kept"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.fold_of(F.col("doc_id")) == 2
    model = language_id.fit(docs.where(~held_out).select("lang", "text"))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the texts with a label of good quality; three quarters of them train the model, the held-out rest
    sets the threshold of each language."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    fold = toxicity.fold_of(F.col("doc_id"))
    # Always by a shuffle, since the labels grow with the documents.
    trusted = docs.select("doc_id", "text").where(fold != 2).join(good.hint("merge"), F.col("doc_id") == F.col("id"))
    model = perplexity.fit(trusted)
    scored = stored(perplexity.perplexities(docs.select("doc_id", "lang", "text"), model), "perplexities")
    unseen = scored.where(fold == 2).join(good, F.col("doc_id") == F.col("id"))
    limits = perplexity.thresholds(unseen)
    return scored.select("doc_id", "lang", "perplexity", perplexity.passes(limits).alias("kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.without_repeats(docs.select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines")))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    settings = toxicity.Toxicity()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), settings)
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.fold_of(F.col("doc_id")) == 2).alias("held_out"), "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards to the shared folder and returns what a reader finds in them, but for the ids."""
    docs, shards = table(spark, sf_dir, "documents"), token_shards.Shards()
    mark = len(stored_since(0))
    pieces = stored(
        token_shards.sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), shards), "sequences", compression="zstd")
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/shards"
    token_shards.write(pieces, path, shards)
    release(spark, stored_since(mark))
    return token_shards.read(spark, path, shards).drop("ids")


def op10_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = sketches.with_next(docs, parts).select(
        "doc_id", "text", "next_text", sketches.edited(F.col("text"), F.col("next_text")).alias("edited"))
    cut = texts.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        *(words(F.col(c)).alias(c) for c in ("text", "edited", "next_text")))
    sketched = cut.select(
        "doc_id", "n_chars", "edited_sha256", *(sketches.sketch(F.col(c)).alias(c) for c in ("text", "edited", "next_text")))
    own, other, following = (F.col(c) for c in ("text", "edited", "next_text"))
    return sketched.select(
        "doc_id", "n_chars", "edited_sha256", sketches.digits(own).alias("fingerprint"),
        sketches.digits(other).alias("edited_fingerprint"), sketches.resemblance(own, other).alias("near_edited"),
        sketches.resemblance(own, following).alias("near_next"), sketches.distinct_count(own).alias("n_shingles"),
        sketches.containment(own, other).alias("contained_in_edited"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 get the next label; those divisible by 100 are the anchors."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(moved, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_perplexity": op5_perplexity,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_token_shards": op9_token_shards,
    "op10_sketches": op10_sketches,
    "op11_decontamination": op11_decontamination,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

