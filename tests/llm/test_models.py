import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedrank.llm import kneser_ney as kn
from feedrank.llm import language_id, perplexity, quality_rules, toxicity
from feedrank.llm.common import stored
from llm.prose import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def plain_measures(text):
    text = text or ""
    w, lines = WORD.findall(text), [line for line in text.split("\n") if WORD.search(line)]
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(lines), sum(c.isupper() and c.isalpha() for c in text))


def test_measures_of_odd_documents(odd_docs, make_docs, no_docs):
    texts = ["a b c d e a b c d e", "x " * 30, "a b c d e f g a b c d e f\nq\nq\n \nq", "Ab CD *** ## é É"]
    for docs in (odd_docs, make_docs(texts), no_docs):
        expected = sorted((str(r["doc_id"]), *plain_measures(r["text"])) for r in docs.collect())
        found = quality_rules.measured(docs).select("doc_id", *quality_rules.MEASURES).collect()
        assert sorted((str(r[0]), *r[1:]) for r in found) == expected


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 7, 50, 400) for k in range(0, n // 20 + 1)]
    table = spark.createDataFrame(rows, "k long, n long")
    for k, n, tail in table.select("k", "n", quality_rules.at_most(F.col("k"), F.col("n"), 0.05)).collect():
        exact = sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))
        assert math.isclose(tail, exact, rel_tol=1e-9) if k <= n * 0.05 else tail == 1.0


def test_cutoffs_keep_good_and_reject_poor(spark, rng):
    def row(i, poor):
        return (i, "en" if i % 2 else None, 100, 500, rng.randint(150, 400) if poor else rng.randint(0, 5), 0, 0, 5, 3)

    columns = "doc_id long, lang string, " + ", ".join(f"{m} long" for m in quality_rules.MEASURES)
    rows = [row(i, i % 10 == 1) for i in range(12000)]
    measures = stored(spark.createDataFrame(rows, columns), "measures")
    labels = spark.createDataFrame([(i, int(i % 10 != 1)) for i in range(12000)] + [(1, None), (None, 1)], "doc_id long, quality int")
    cutoffs = quality_rules.choose_cutoffs(measures, labels)
    assert {(r["stratum"], r["rule"]) for r in cutoffs.collect()} == {("en", "symbol_ratio")}
    kept = measures.select("doc_id", "lang", quality_rules.passes(cutoffs).alias("kept")).collect()
    assert all(r["kept"] == (r["doc_id"] % 10 != 1 or r["lang"] is None) for r in kept)
    few = quality_rules.choose_cutoffs(stored(measures.where("doc_id < 300"), "few"), labels)
    assert few.count() == 0  # too few to certify anything
    assert quality_rules.choose_cutoffs(measures.limit(0), labels.limit(0)).count() == 0


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 40):
        bits = language_id.codewords(n)
        assert bits.shape[0] == n and all(0 < c < n for c in bits.sum(axis=0))
        apart = [int((a != b).sum()) for i, a in enumerate(bits) for b in bits[:i]]
        assert min(apart) >= {2: 1, 3: 2, 4: 4, 5: 8}.get(n, 8)


def speech(rng, lang, n):
    sounds = {"aa": ["la", "mi", "no"], "bb": ["kra", "stu", "gh"], "cc": ["zü", "ñe", "ço"]}[lang]
    return " ".join("".join(rng.choices(sounds, k=rng.randint(1, 4))) for _ in range(n))


def test_languages_are_told_apart(spark, make_docs, rng, odd_docs, no_docs):
    langs = [rng.choice(["aa", "bb", "cc", None]) for _ in range(400)]
    texts = [speech(rng, lang or "aa", rng.randint(5, 60)) for lang in langs]
    docs = make_docs(texts, lang=langs)
    model = language_id.fit(docs.where("doc_id % 4 <> 0").select("lang", "text"))
    found = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(found[i]["lang_pred"] == (lang or "aa") and 0 <= found[i]["score"] <= 1 for i, lang in enumerate(langs))
    rows = {r["doc_id"]: r for r in language_id.predict(odd_docs, model).collect() if r["doc_id"] is not None}
    assert [i for i in range(14) if rows[i]["lang_pred"] == "und"] == [0, 1, 2, 12]
    assert rows[0]["score"] == 0.0
    assert language_id.predict(no_docs, model).count() == 0
    untaught = language_id.fit(no_docs.select("lang", "text"))
    assert {r["lang_pred"] for r in language_id.predict(docs, untaught).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'bb'").select("lang", "text"))
    assert {r["lang_pred"] for r in language_id.predict(docs, one).collect()} == {"bb"}
    mixed = make_docs([speech(rng, "aa", 30) + " " + speech(rng, "bb", 30)])
    assert language_id.predict(mixed, model).first()["score"] < 1.0


def plain_model(texts, order):
    """The probability of every seen n-gram by interpolated modified Kneser-Ney, from the definition."""
    data = [b" " * order + b" ".join((t or "").lower().encode().split()) + (b" " if (t or "").split() else b"") for t in texts]
    tables = {order: Counter(d[i : i + order] for d in data for i in range(len(d) - order + 1))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    p = {0: {b"": 1 / 256}}
    for k in range(1, order + 1):
        n = [sum(c == i for c in tables[k].values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i, 0.05), 0.95 * i) for i in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, c in tables[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        p[k] = {g: (c - d[min(c, 3) - 1]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p[k - 1][g[1:]]
                for g, c in tables[k].items()}
        p[k, "left"] = {h: left[h] / total[h] for h in total}
    return p


def plain_log(p, gram):
    k = len(gram)
    if not k:
        return -math.log(256)
    if gram in p[k]:
        return math.log(p[k][gram])
    return math.log(p[k, "left"].get(gram[:-1], 1.0)) + plain_log(p, gram[1:])


def test_perplexity_is_that_of_the_definition(make_docs, rng, no_docs):
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(40)] + ["", "  ", "Ü é"]
    order = 3
    model = perplexity.fit(make_docs(texts), perplexity.Perplexity(order=order, slots=1 << 24))
    p = plain_model(texts, order)
    new = [*texts[:3], "zzz qqq", "", None, "ba ke##", prose(rng, 30)]
    found = {r["doc_id"]: r["perplexity"] for r in perplexity.perplexities(make_docs(new), model).collect()}
    for i, text in enumerate(new):
        d = kn.prepared(text, order)
        logs = [plain_log(p, d[j : j + order]) for j in range(len(d) - order + 1)]
        assert math.isclose(found[i], math.exp(-sum(logs) / len(logs)), rel_tol=2e-4)
    assert perplexity.perplexities(no_docs, model).count() == 0
    untaught = perplexity.fit(no_docs)
    assert math.isclose(perplexity.perplexities(make_docs(["abc"]), untaught).first()["perplexity"], 256, rel_tol=1e-5)


def test_perplexity_is_exact_in_many_parts(make_docs, rng):
    """Far more n-grams than a part holds: each is found under its own key, and unseen ones back off."""
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(40)] + ["Ü é"]
    order, new = 3, [*texts[:3], "zq jz xx", "abc" * 50, "", None]
    p = plain_model(texts, order)
    model = perplexity.fit(make_docs(texts), perplexity.Perplexity(order=order, slots=64))
    assert len(model.tables.parts) > 5
    found = {r["doc_id"]: r["perplexity"] for r in perplexity.perplexities(make_docs(new), model).collect()}
    for i, text in enumerate(new):
        d = kn.prepared(text, order)
        logs = [plain_log(p, d[j : j + order]) for j in range(len(d) - order + 1)]
        assert math.isclose(found[i], math.exp(-sum(logs) / len(logs)), rel_tol=1e-5)


def test_thresholds_are_by_language(spark):
    scored = spark.createDataFrame(
        [("a", float(i)) for i in range(100)] + [("b", 1000.0 + i) for i in range(100)] + [(None, 5.0)], "lang string, perplexity double")
    limits = perplexity.thresholds(scored, perplexity.Perplexity(quantile=0.9))
    rows = scored.unionByName(spark.createDataFrame([("c", 9e9)], scored.schema))
    kept = rows.withColumn("kept", perplexity.passes(limits)).groupBy("lang").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()
    assert {r["lang"]: r["n"] for r in kept} == {"a": 90, "b": 90, None: 1, "c": 1}
    assert rows.withColumn("kept", perplexity.passes(limits.limit(0))).where("kept").count() == rows.count()


def test_toxic_words_are_learned(spark, make_docs, rng, odd_docs, no_docs):
    texts, toxic = [], []
    for i in range(800):
        words = prose(rng, rng.randint(20, 200)).split(" ")
        toxic.append(int(i % 5 == 0))
        if toxic[-1]:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(["grunk", "Blarg!", "snorfing"]))
        texts.append(" ".join(words))
    docs = make_docs(texts)
    rows = [(i, t) for i, t in enumerate(toxic) if i % 3] + [(1, None), (None, 1), (7, 0), (7, toxic[7])]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    right = [(found[i] >= 0.3) == bool(t) for i, t in enumerate(toxic) if fold(i) == 2]
    assert np.mean(right) > 0.98 and all(0 <= s <= 1 for s in found.values())
    kept = toxicity.without_toxic(odd_docs, model, 0.3)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    unlabelled = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, unlabelled).collect()} == {0.0}
    assert toxicity.known_labels(labels, 100).count() < 160


def test_expressions_are_counted_by_documents(spark):
    texts = spark.createDataFrame([(0, "a b a b c"), (0, "a b"), (1, "x b b"), (1, None), (0, "  ")], "`class` int, text string").repartition(2)
    words, contexts, pairs, _ = toxicity.counted(texts)
    a, b = (int(toxicity.hashed(w)[0]) for w in "ab")
    assert {r["word"]: (r["n0"], r["n1"], r["k"]) for r in words.collect()}[b] == (2, 1, 3)
    assert {r["before"]: (r["n0"], r["n1"], r["t0"], r["t1"]) for r in contexts.collect()}[b] == (2, 1, 2, 1)
    assert [tuple(r) for r in pairs.where(F.col("word") == b).collect()] == [(b, a, 2, 0)]


def plain_ratio(texts, settings):
    """What each word after another adds to a raw score, by definition; `texts`: (class, words)."""
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for c, w in texts:
        words[c].update(set(w))
        pairs[c].update(set(zip([""] + w[:-1], w)))
    after = Counter(w for _, w in pairs[0].keys() | pairs[1].keys())

    def three(values):
        n = [sum(v == i for v in values) for i in (1, 2, 3, 4)]
        if not n[0]:
            return (0.5,) * 3
        y = n[0] / (n[0] + 2 * n[1])
        found = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i for i in (1, 2, 3)]
        return [min(max(d, 0.05), 0.95 * i) for i, d in zip((1, 2, 3), found)]

    def level(counts, below):
        d, total = three(list(counts.values())), sum(counts.values())
        taken = {w: d[min(n, 3) - 1] for w, n in counts.items()}
        left = sum(taken.values()) / total
        return lambda w: (counts[w] - taken.get(w, 0)) / total + left * below(w)

    def trust(n, share, doubt):
        g = 2 * sum(n[c] * math.log(n[c] / (sum(n) * s)) for c, s in ((0, 1 - share), (1, share)) if n[c])
        return max(0.0, 1 - doubt**2 / g) if g > 0 else 0.0

    shared = level(after, lambda w: 1 / len(after))
    own = [level(words[c], shared) for c in (0, 1)]
    totals = [sum(words[c].values()) for c in (0, 1)]

    def single(w):
        p = [f(w) for f in own]
        far = abs(math.log(p[1] / p[0]))
        s = trust([words[0][w], words[1][w]], totals[1] / sum(totals), settings.doubt) * max(0.0, 1 - settings.margin / far) if far else 0.0
        return [s * x + (1 - s) * shared(w) for x in p]

    sums = [sum(pairs[c].values()) for c in (0, 1)]

    def value(before, w):
        if not after[w]:
            return 0.0
        q, n = single(w), [pairs[0][before, w], pairs[1][before, w]]
        s = trust(n, sums[1] * q[1] / (sums[1] * q[1] + sums[0] * q[0]), settings.pair_doubt) if sum(n) > 1 else 0.0
        out = []
        for c in (0, 1):
            once, twice = (sum(v == i for v in pairs[c].values()) for i in (1, 2))
            d = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
            here = [v for (b, _), v in pairs[c].items() if b == before]
            p = (max(n[c] - d, 0) + d * len(here) * q[c]) / sum(here) if here else q[c]
            out.append(s * p + (1 - s) * q[c])
        return math.log(out[1] / out[0])

    return value


def test_raw_scores_are_those_of_the_definition(spark, make_docs, rng):
    vocabulary = [f"w{i}" for i in range(25)]
    texts = [[rng.choice(vocabulary[: 25 if i % 3 else 12]) for _ in range(rng.randint(1, 25))] for i in range(160)]
    for i in range(0, 160, 3):
        texts[i] += ["w1", "bad", "w2", "w3"] if i % 2 else ["w4", "w5"] * 2
    toxic = [int(i % 3 == 0) for i in range(160)]
    settings = toxicity.Toxicity(doubt=1.0, pair_doubt=1.5, margin=0.1)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    docs = make_docs([" ".join(w) for w in texts] + ["unknown words", "", None, "W1! bad"])
    model = toxicity.fit(docs, labels, settings)
    value = plain_ratio([(toxic[i], w) for i, w in enumerate(texts) if fold(i) < 2], settings)
    found = {r["doc_id"]: r["raw"] for r in toxicity.score(docs, model).collect()}
    plain = [sum(value(b, x) for b, x in zip([""] + w[:-1], w)) / max(1, len(w)) for w in [*texts, ["unknown", "words"], [], [], ["w1", "bad"]]]
    assert [found[i] for i in range(len(plain))] == pytest.approx(plain, abs=1e-5)
    assert min(plain) < -0.05 and max(plain) > 0.05  # evidence for either class


def test_an_expression_of_ordinary_words_is_found(spark, make_docs, rng):
    """Both words are as frequent in both classes; only one after the other are they toxic."""
    texts, toxic = [], [int(i % 4 == 0) for i in range(1200)]
    for t in toxic:
        words = prose(rng, rng.randint(20, 60)).split(" ")
        for _ in range(2):
            at = rng.randrange(len(words))
            words[at:at] = ["green", "cheese"] if t else rng.choice([["cheese", "green"], ["green", "and", "cheese"]])
        texts.append(" ".join(words))
    docs = make_docs(texts)
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held_out = [i for i in range(1200) if fold(i) == 2]
    assert np.mean([(found[i] >= 0.3) == bool(toxic[i]) for i in held_out]) > 0.95


def test_toxicity_keeps_all_expressions(spark, make_docs):
    """With few labels for the curve and few expressions in a part; and a word after more words than 16 bits tell apart."""
    toxic = [int(i % 2) for i in range(600)]
    docs = make_docs([" ".join(f"bad{j}x good{j + i % 7}" if t else f"good{j} fine{i}" for j in range(i % 40, i % 40 + 12)) for i, t in enumerate(toxic)])
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    whole = toxicity.fit(docs, labels)
    parts = toxicity.fit(docs, labels, toxicity.Toxicity(slots=16, most_labels=40))
    words = toxicity.hashed(" ".join(f"bad{j}x" for j in range(51)))
    assert len(parts.trusted.parts) > 1 and len(set(words.tolist())) == 51
    assert (whole.values(words) > 0).sum() > 30 and (parts.values(words) == whole.values(words)).all()
    n = 80_000
    texts = spark.createDataFrame([(0, " ".join(f"w{i} the" for i in range(n)))], "`class` int, text string")
    the = toxicity.counted(texts)[0].where(F.col("word") == int(toxicity.hashed("the")[0])).first()
    assert (the["n0"], the["n1"], the["k"]) == (1, 0, n)
