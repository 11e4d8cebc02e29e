import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from feedrank.llm import collocations
from feedrank.llm.collocations import Collocations, chunks
from llm.prose import prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_counts(text):
    found = Counter()
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        w = re.findall(r"[^\x20\x09]+", piece)
        found.update(" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return found


def plain(docs, s):
    """The same from all phrases of all texts, held at once."""
    by_lang = defaultdict(Counter)
    for lang, text in docs:
        by_lang[lang or "und"].update(plain_counts(text))
    rows = []
    for lang, f in by_lang.items():
        n = sum(c for p, c in f.items() if " " not in p)
        candidates = {p: c for p, c in f.items() if " " in p and c >= s.least}
        longer = defaultdict(int)
        for p, c in candidates.items():
            w = p.split(" ")
            if len(w) == 3:
                for part in (" ".join(w[:2]), " ".join(w[1:])):
                    longer[part] = max(longer[part], c)
        rated = []
        for p, a in candidates.items():
            w = p.split(" ")
            if len(w) == 2 and p in longer and 100 * longer[p] >= s.absorbed * a:
                continue
            cuts = [(10**6 * a * a // (l * r), k, l, r) for k in range(1, len(w)) for l, r in [(f[" ".join(w[:k])], f[" ".join(w[k:])])]]
            value, _, l, r = min(cuts)
            rated.append((-value, -a, p.encode(), l, r))
        for rank, (value, a, p, l, r) in enumerate(sorted(rated)[: s.first], 1):
            rows.append((lang, rank, p.decode(), -a, l, r, n, -value))
    return sorted(rows)


def rows(found):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


def test_phrases_of_prose(make_docs, rng):
    vocabulary = prose(rng, 25).lower().replace("\n", " ").replace(".", "").split()
    texts = [rng.choice([" ", "  ", "\t"]).join(
        rng.choice(vocabulary).title() + rng.choice(["", "", "", "", ",", "!", "\n", "\r\n. "]) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts += [texts[0]] * 15 + ["same same " * 900, "ab! " * 40, None, ""]
    langs = [rng.choice(["en", "de", None, "und"]) for _ in texts]
    docs = make_docs(texts, lang=langs)
    for s in (Collocations(), Collocations(modulus=1, first=7, parts=2), Collocations(modulus=2, longest=3, held=50, least=2, absorbed=90),
              Collocations(modulus=10**9, longest=2, least=5, parts=1)):
        expected = plain(list(zip(langs, texts)), s)
        assert rows(collocations.collocations(docs, s)) == expected and expected


def test_odd_and_no_texts(odd_docs, no_docs):
    s = Collocations(least=1, first=10**6)
    docs = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert rows(collocations.collocations(odd_docs, s)) == plain(docs, s)
    assert collocations.collocations(no_docs).count() == 0


def test_chunks_hold_every_phrase_once():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 90), 7) for _ in range(30)] + ["", "one", "one two", "a b c", "x " * 100]
    for s in (Collocations(modulus=3), Collocations(modulus=1), Collocations(modulus=10**9, longest=2)):
        found = Counter()
        for chunk, times in Counter(chunks([t.encode() for t in texts], s)).items():
            pieces = [piece.split(" ") for piece in chunk.decode().split("\n")]
            each = [piece[i : i + 3] for piece in pieces for i in range(len(piece))][:-2]
            for phrase in each:
                for k in range(1, len(phrase) + 1):
                    found[" ".join(phrase[:k])] += times
        assert found == sum((plain_counts(t) for t in texts), Counter())


def test_texts_that_share_a_passage_share_its_chunks():
    rng = random.Random(9)
    passage = prose(rng, 400)
    a, b = (set(chunks([(prose(rng, 30) + "\n" + passage + " " + prose(rng, 30)).encode()])) for _ in range(2))
    assert len(a & b) > 0.7 * min(len(a), len(b))


def test_rare_phrases_are_not_counted_one_by_one(make_docs):
    """Of 18,000 rare phrases hardly any is passed on; what is frequent is, with all its times."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.getrandbits(60):x}" for _ in range(200)) + ". often said here" for _ in range(30)]
    s = Collocations(block=2000)
    sent = Counter()
    for row in collocations.passed(collocations.dictionary(make_docs(texts), s), s).collect():
        sent[row["phrase"]] += row["times"]
    assert {p: n for p, n in sent.items() if n >= s.least} == {"": 30 * 203, **{p: 30 for p in plain_counts("often said here")}}
    assert len(sent) < 50


def test_counts_do_not_depend_on_the_filter(make_docs):
    """Keys that share a place, repeated chunks, and times that need one byte or two until they are enough."""
    rng = random.Random(8)
    texts = [prose(rng, 120, 9) for _ in range(40)] + [prose(random.Random(1), 60)] * 300
    langs = [rng.choice(["en", "de"]) for _ in texts]
    docs = make_docs(texts, lang=langs)
    for s in (Collocations(bits=14, block=1, least=3), Collocations(bits=14, least=255), Collocations(bits=20, block=100, least=256, modulus=1)):
        expected = plain(list(zip(langs, texts)), s)
        assert rows(collocations.collocations(docs, s)) == expected
    assert not collocations.collocations(docs, Collocations(least=2**40)).count()


def test_scores_are_exact(spark):
    rng = random.Random(1)
    counts = []
    for size in (10, 10**6, 10**10, 10**15):
        for _ in range(50):
            a = rng.randint(1, size)
            counts.append((a, a + rng.randint(0, size), a + rng.randint(0, 3)))
    found = spark.createDataFrame(counts, "a long, l long, r long").select(
        "a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in found)
