import re

import numpy as np
import pytest

from feedrank.llm import decontamination, hashed_words
from feedrank.llm.decontamination import Decontamination, contamination
from llm.prose import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, window):
    """For each document its words, the words in windows, and the items, by comparing every place with every window."""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


def rows(found):
    for r in found:
        covered = {i for s in r["spans"] for i in range(s["start"], s["stop"])}
        assert len(covered) == r["n_hit"]
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found), key=repr)


@pytest.fixture
def make_items(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string")


def test_passages_of_documents(make_docs, make_items, rng):
    passages = [prose(rng, n) for n in (9, 10, 11, 40, 3, 2, 1)]
    passages += [passages[3], " ".join(passages[3].split()[5:30]), "the the the the the the the the the the the the"]
    items = [*((i, p) for i, p in enumerate(passages)), (3, prose(rng, 15)), (50, None), (51, ""), (52, " .,;"), (None, prose(rng, 12))]
    texts = []
    for i in range(150):
        words = prose(rng, rng.randint(1, 60)).split()
        for _ in range(rng.randint(0, 2)):
            source = (rng.choice(items)[1] or "x").split() or ["x"]
            at, cut = rng.randint(0, len(words)), rng.randint(0, len(source) - 1)
            words[at:at] = [w.upper() if rng.random() < 0.2 else w for w in source[cut : cut + rng.randint(1, 40)]]
        texts.append(rng.choice(["\n", " - ", "...", " "]).join(words))
    texts += ["the " * 50, "the " * 9, *texts[:5]]
    docs = make_docs(texts)
    for settings in (Decontamination(), Decontamination(window=4, shingle=2), Decontamination(window=2, shingle=3), Decontamination(window=1, shingle=1)):
        found = contamination(docs, make_items(items), settings).collect()
        assert rows(found) == plain(list(enumerate(texts)), items, settings.window)


def test_odd_and_no_rows(odd_docs, no_docs, make_items):
    items = [(1, "a b c d e f g h i j"), (2, "no id"), (3, "日本語 テスト"), (3, "x" * 5000), (-4, "and 😀")]
    expected = plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()], items, 10)
    assert rows(contamination(odd_docs, make_items(items)).collect()) == expected
    assert {r[3] for r in expected} >= {("1",), ("2",), ("3",)}
    none = rows(contamination(odd_docs, make_items([])).collect())
    assert len(none) == odd_docs.count() and all(r[2:] == (0, ()) for r in none)
    assert contamination(no_docs, make_items(items)).count() == 0


def test_extra_columns_and_string_ids(spark):
    docs = spark.createDataFrame([("a", "one two three", 1, 2, "x")], "doc_id string, text string, row int, w int, hits string")
    items = spark.createDataFrame([("b", "Two, THREE", 1)], "item_id string, text string, words int")
    assert rows(contamination(docs, items).collect()) == [("a", 3, 2, ("b",))]


def test_a_full_filter_loses_nothing(make_docs, make_items, rng, monkeypatch):
    monkeypatch.setattr(decontamination, "bitmap", lambda hashes, column: hashed_words.bitmap(hashes, column, 6))
    items = [(i, prose(rng, 30)) for i in range(20)]
    texts = [prose(rng, 20) + " " + items[i % 20][1] for i in range(30)]
    assert rows(contamination(make_docs(texts), make_items(items)).collect()) == plain(list(enumerate(texts)), items, 10)


def test_words_do_not_depend_on_blocks(rng, monkeypatch):
    gap = np.array([b == 32 for b in range(256)])
    words = ["".join(rng.choices("abcdé", k=rng.choice([1, 3, 40, 63, 64, 65, 200]))) for _ in range(300)]
    data = (rng.choice([" ", "   "]).join(words)).encode()
    monkeypatch.setattr(hashed_words, "BLOCK", 64)
    hashed_words._powers.cache_clear()
    try:
        hashes, starts, ends = hashed_words.words_of(data, gap)
        assert [data[a:b].decode() for a, b in zip(starts, ends)] == words
        single = [hashed_words.words_of(w.encode(), gap)[0].tolist() for w in words]
        assert [[h] for h in hashes.tolist()] == single
        assert len(set(hashes.tolist())) == len(set(words))
        assert len(hashed_words.words_of(b"    ", gap)[0]) == len(hashed_words.words_of(b"", gap)[0]) == 0
    finally:
        hashed_words._powers.cache_clear()
