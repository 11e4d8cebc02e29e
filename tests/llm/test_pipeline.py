import random

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as driver
from conftest import SMALL
from feedrank.llm import queries
from llm.prose import prose
from llm.test_bpe_and_packing import check_pieces
from llm.test_near_dedup import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with clean, copied, poor and toxic documents, and the odd ones."""
    rng, path = random.Random(8), tmp_path_factory.mktemp("tables")
    texts, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randint(60, 150)).split(" ")
        if i % 6 == 0:
            words = [w for word in words for w in ((word, "grunk") if rng.random() < 0.1 else (word,))]
        texts.append(" ".join(words))
        labels.append((i, 1, int("grunk" in words)))
    passage = prose(rng, 60, per_line=60)
    texts += [texts[1], texts[2] + " more", passage + "\n" + prose(rng, 70), prose(rng, 70) + "\n" + passage, None, "", "a b"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(rng, 30), None, None, None), (3, texts[3], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), texts


def test_stages_decide_and_keep_columns(spark, folder, tmp_path):
    path, texts = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    toxic = {i for i in range(600) if "grunk" in texts[i].split(" ")}
    assert set(kept["quality_rules"]) == {*range(604), None}
    assert set(kept["toxicity"]) == {*range(604), None} - toxic
    assert kept["line_dedup"][603]["text"] != texts[603] and kept["line_dedup"][602]["text"] == texts[602]
    assert kept["line_dedup"][600]["text"] == "" if "\n" not in texts[1] else True
    assert 3 in kept["simhash_near_dedup"] and None in kept["simhash_near_dedup"]
    assert {d for d in kept["packing"]} == set(kept["simhash_near_dedup"])
    ids = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/simhash_near_dedup").collect()]
    assert len(ids) == len(set(ids))


def test_run_equals_its_stages(spark, folder):
    path, _ = folder
    rows = driver.queries()["pipeline"](spark, path).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_every_operator_has_its_query():
    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14)) and set(queries.QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "labels", "benchmark", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    result, relation = driver.queries()[name](spark, SMALL), duck.sql(driver.oracle_sql()[name])
    columns = sorted(result.columns)
    assert sorted(relation.columns) == columns
    rows, places = sorted(repr(tuple(r[c] for c in columns)) for r in result.collect()), [relation.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[p] for p in places)) for r in relation.fetchall()) and rows


def test_stages_take_odd_and_no_documents(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for kind, docs in (("odd", odd_docs), ("no", no_docs)):
        columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{kind}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{kind}/{name}")
            assert {r["doc_id"] for r in docs.collect()} <= ids
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        assert (docs.count() > 0) == (kind == "odd")


def test_queries_take_no_documents(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in [*queries.QUERIES, "pipeline"]:
        assert driver.queries()[name](spark, str(tmp_path)).count() == 0, name


def test_near_dedup_loses_no_text_of_a_repeated_id(spark, no_docs):
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (3, a), (3, b), (5, b), (5, b), (5, c), (5, c), (None, c), (None, d), (None, d), (None, a), (7, d + " "), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], no_docs.schema).repartition(4)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.distinct(spark, docs, "").collect())
    assert kept == sorted([("1", a), ("3", b), ("5", c), ("7", d + " "), ("9", None)])


def plain_distinct(rows):
    """Of each component of fingerprints the smallest ids, by comparing all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    found = plain_components(links, range(len(rows)))
    return sorted(min(rows[i][0] for i in found if found[i] == c) for c in set(found.values()))


def test_near_dedup_equals_brute_force(spark, no_docs):
    rng = random.Random(6)
    texts = [prose(rng, rng.choice([3, 8, 300])) for _ in range(60)]
    texts += [" ".join(t.split(" ")[: -rng.randint(1, 2)]) for t in texts] + texts[:20]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], no_docs.schema).repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, "").collect()) == plain_distinct(rows)


def test_packing_stage_covers_every_document(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = corpus_pipeline.packed(spark, docs, path).collect()
    check_pieces(pieces, {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)
