import random

import pytest

from llm.prose import prose

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators also use inside.
EXTRA = ", total double, units int, runs string, d int, t int, word string, h long, fingerprint string, score string, bits long, __t long, u int, part int, `class` int"


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def odd_texts(rng):
    """Null, empty and blank texts, repeats, a very long text, other scripts, control characters."""
    long_text = prose(rng, 6000)
    return [
        None, "", "   \n\t ", "one", "one", "Tabs\tand  runs \r\n of\x0bspace", "ü é 日本語 テスト\nÄ", long_text, long_text,
        "a b c d e f g h i j k l", "\x00 nul\x1c and 😀", "x" * 5000, "###$$$ %%% &&& ||| <>", prose(rng, 80),
    ]


@pytest.fixture
def odd_docs(spark, odd_texts):
    rows = [(i, t, "en" if i % 3 else None, None, None) for i, t in enumerate(odd_texts)]
    rows += [(None, "no id here", None, None, None), rows[9], rows[9]]
    full = [(*r, 1.0, 1, "r", 1, 1, "w", 1, "f", "s", 2, 3, 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS + EXTRA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def make_docs(spark):
    def make(texts, first=0, lang="en"):
        langs = lang if isinstance(lang, list) else [lang] * len(texts)
        rows = [(first + i, t, l, "s", len(t or "")) for i, (t, l) in enumerate(zip(texts, langs))]
        return spark.createDataFrame(rows, DOCUMENTS).repartition(3)

    return make
