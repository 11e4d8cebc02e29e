import re
from collections import defaultdict

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from feedrank.llm import line_dedup, simhash, sketches
from feedrank.llm.common import stored, words
from feedrank.operators.components import components
from llm.prose import prose

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_of_odd_documents(odd_docs):
    found = sorted((str(r["doc_id"]), r["bits"] % 2**64) for r in simhash.fingerprints(odd_docs).collect())
    assert found == sorted((str(r["doc_id"]), plain_fingerprint(r["text"])) for r in odd_docs.collect())


def test_components(spark, rng):
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(i, i + 1) for i in range(400, 460)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = plain_components(links, {n for a, b in links if a != b for n in (a, b)})
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def clustered(rng, n):
    """Fingerprints with close groups, chains of close ones, and equal ones."""
    made = []
    while len(made) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 5, 40])):
            made.append(base)
            for _ in range(rng.randint(0, 2)):
                base ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                made.append(base ^ 1 << rng.randrange(64))
    return made[:n]


def test_search_finds_the_components_of_all_links(spark, rng):
    prints = clustered(rng, 2500) + [0, 0, 2**64 - 1]
    rows = [(i * 3, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)] + [(None, 5)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, bits long")
    v = np.array(prints, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    links = [(int(a) * 3, int(b) * 3) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    expected = plain_components(links, [i * 3 for i in range(len(prints))])
    for leaf, sample, local in ((64, 1 << 18, 8), (64, 300, 8), (10**6, 10, 384)):
        found = simhash.near_duplicates(table, simhash.SimHash(leaf=leaf, sample=sample, local=local)).collect()
        assert len(found) == len(rows)
        assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == expected
        assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]


def test_near_duplicates_of_no_documents(no_docs):
    assert simhash.near_duplicates(stored(simhash.fingerprints(no_docs), "prints")).count() == 0


def plain_repeats(texts, minimum):
    """The rule by all runs of `minimum` words or more, of any length; `texts`: (doc_id, text) in order."""
    units = [[(i, line, len(WORD.findall(line))) for i, line in enumerate(t.split("\n")) if WORD.search(line)] for _, t in texts]
    seen, gone = set(), defaultdict(set)
    for d, own in enumerate(units):
        for start in range(len(own)):
            for end in range(start + 1, len(own) + 1):
                if sum(u[2] for u in own[start:end]) >= minimum:
                    key = tuple(u[1] for u in own[start:end])
                    if key in seen:
                        gone[d] |= set(range(own[start][0], own[end - 1][0] + 1))
                    seen.add(key)
    return ["\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone[d]) for d, (_, t) in enumerate(texts)]


def test_repeated_runs_are_deleted(make_docs, rng):
    shared = [prose(rng, 70, per_line=n) for n in (5, 12, 70)]
    short = prose(rng, 20, per_line=7)
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(1, 60), per_line=rng.choice([3, 12])) for _ in range(2)]
        parts.insert(rng.randint(0, 2), rng.choice([*shared, short, short + "\n\n" + shared[0]]))
        texts.append("\n".join(parts))
    texts += ["same line of words\n" * 40, shared[1] + "\n" + shared[1], shared[2]]
    for minimum in (50, 12):
        found = line_dedup.without_repeats(make_docs(texts), minimum).collect()
        assert {r["doc_id"]: r["text"] for r in found} == dict(enumerate(plain_repeats(list(enumerate(texts)), minimum)))


def test_lines_around_a_repeated_run_are_compared_with_all_its_places(make_docs, rng):
    """The run comes first with other lines around it than those it is repeated with."""
    w, x, y, z = (prose(rng, n, per_line=n) for n in (60, 40, 40, 10))
    texts = [f"{w}\n{x}", f"{w}\n{y}", f"{w}\n{y}\n{x}", f"{y}\n{w}", f"{z}\n{y}\n{w}\n{x}"]
    found = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(make_docs(texts)).collect()}
    assert found == {0: texts[0], 1: y, 2: x, 3: y, 4: z}
    assert plain_repeats(list(enumerate(texts)), 50) == list(found[i] for i in range(5))


def test_overlapping_runs_of_few_different_lines(make_docs, rng):
    lines = [prose(rng, n, per_line=n) for n in (1, 2, 4, 7, 11)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    for minimum in (3, 15, 30):
        found = line_dedup.without_repeats(make_docs(texts), minimum).collect()
        assert {r["doc_id"]: r["text"] for r in found} == dict(enumerate(plain_repeats(list(enumerate(texts)), minimum)))


def test_few_places_are_selected(make_docs, rng):
    docs = make_docs([prose(rng, 3000, per_line=2)])
    selected = line_dedup._selected(line_dedup._documents(docs, "doc_id", "text"), 50)
    assert selected.count() < 1500 / 8  # 25 lines a window: two in 26


def test_sql_of_line_dedup(spark, tmp_path):
    from feedrank.llm import queries

    found = {r["doc_id"]: r["text"] for r in queries.op6_line_dedup(spark, SMALL).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    rows = db.execute(queries.ORACLES["op6_line_dedup"]).fetchall()
    assert found == {r[0]: r[2] for r in rows} and len(rows) > 50


def test_line_dedup_of_odd_documents(odd_docs, no_docs):
    assert line_dedup.without_repeats(no_docs).count() == 0
    before = odd_docs.collect()
    found = line_dedup.without_repeats(odd_docs)
    assert found.columns == odd_docs.columns and found.count() == len(before)
    texts = {r["doc_id"]: r["text"] for r in found.collect()}
    assert texts[0] is None and texts[1] == "" and texts[7] == before[7]["text"] and texts[8] == ""
    assert all(texts[r["doc_id"]] == r["text"] for r in before if r["doc_id"] not in (8,))


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_estimate_and_merge(spark, rng):
    parts = [prose(rng, n) for n in (3, 40, 90, 400, 900)] + ["", "  ", "one"]
    pairs = [(a, b) for a in parts for b in parts] + [(parts[3] + " " + parts[4], parts[4])]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", words(F.col("a")).alias("x"), words(F.col("b")).alias("y"))
    for k, error in ((4096, 1e-9), (256, 0.15)):
        done = df.select("a", "b", sketches.sketch(F.col("x"), k).alias("x"), sketches.sketch(F.col("y"), k).alias("y")).select(
            "a", "b", sketches.resemblance(F.col("x"), F.col("y"), k).alias("j"), sketches.containment(F.col("x"), F.col("y"), k).alias("c"),
            sketches.distinct_count(F.col("x"), k).alias("n"))
        for r in done.collect():
            a, b = shingles(r["a"]), shingles(r["b"])
            assert abs(r["j"] - likeness(a, b)) <= error
            assert abs(r["c"] - (len(a & b) / len(a) if a else 1.0)) <= max(error, 1e-6) * 1.5
            assert abs(r["n"] - len(a)) <= max(error * len(a), 1e-6)
    rows = [(i % 2, h) for i, h in enumerate(parts)]
    grouped = spark.createDataFrame(rows, "g int, t string").select("g", sketches.sketch(words(F.col("t")), 64).alias("s"))
    for r in sketches.merged(grouped, ["g"], "s", 64).collect():
        own = [sketch["s"] for sketch in grouped.where(F.col("g") == r["g"]).collect()]
        assert r["s"] == sorted({h for s in own for h in s})[:64]


def test_next_text_follows_the_order_of_ids(make_docs, odd_docs, no_docs):
    texts = [f"text {i}" for i in range(57)] + [None]
    for parts in (1, 4, 9):
        rows = {r["doc_id"]: r["next_text"] for r in sketches.with_next(make_docs(texts), parts).collect()}
        assert rows == {i: (texts[(i + 1) % 58] or "") for i in range(58)}
    assert sketches.with_next(no_docs, 4).count() == 0
    rows = odd_docs.collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, (r["text"] or "")))
    expected = sorted((str(r["doc_id"]), order[(i + 1) % len(order)]["text"] or "") for i, r in enumerate(order))
    found = sketches.with_next(odd_docs, 3).collect()
    assert sorted((str(r["doc_id"]), r["next_text"]) for r in found) == expected


def test_edited_text(spark):
    rows = spark.createDataFrame([("abcdé", "XYZ"), ("", "q"), ("a", "b"), ("ab😀d", "")], "a string, b string")
    assert [r[0] for r in rows.select(sketches.edited(F.col("a"), F.col("b"))).collect()] == ["abcXY", "", "a", "ab"]
