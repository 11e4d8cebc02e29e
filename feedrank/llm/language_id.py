"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of bits; one binary classifier per bit weighs hashed n-grams of bytes by
the logarithm of how much likelier they are in the languages with that bit set than in the others, each
language counting alike. A text's margins are decoded to the codeword of least loss, each bit weighted by
how well it did on labelled texts; the second-best codeword tells how ambiguous the text is.

Counts are sums over all labelled texts, added up in each task and then by Spark. Only scales and
weights of the bits are fitted on a bounded sample (`tuning` texts). What is broadcast is bounded by `most_languages`
and `slots`; more languages than that raise.

Defined results: null texts and texts without a letter are `und` with score 0; rows with a null language
teach nothing; with no labelled row every text is `und`, with one language every text has it; repeated
rows count as rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedrank.llm.common import release, rows_of, stored, stored_since

UNKNOWN = "und"
#: ASCII that is no letter becomes a space; other characters are kept.
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")
BLOCK = 1 << 20
_PRIME = 2147483629


@dataclass(frozen=True)
class LanguageId:
    """`orders`: lengths of the n-grams in bytes; `slots`: features, a power of two; `tuning`: texts for the
    scales of the bits; `ambiguous`: below which score a text is flagged."""

    orders: tuple[int, ...] = (1, 2, 3, 4)
    slots: int = 1 << 14
    tuning: int = 20_000
    most_languages: int = 512
    smoothing: float = 0.5
    ambiguous: float = 0.7


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def features(text: str, orders: tuple[int, ...], slots: int) -> np.ndarray:
    """How often each slot occurs among the n-grams of a whole text."""
    data = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "
    whole = np.frombuffer(data, np.uint8)
    out = np.zeros(slots, np.int64)
    for start in range(0, len(whole), BLOCK):
        part = whole[start : start + BLOCK + max(orders) - 1].astype(np.uint64)
        for order in orders:
            n = min(BLOCK, len(part) - order + 1)
            if n <= 0:
                continue
            key = np.full(n, order, np.uint64)
            for i in range(order):
                key = key << np.uint64(8) | part[i : i + n]
            out += np.bincount((key % np.uint64(_PRIME) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return out


@cache
def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """A row of bits for each language; columns part the languages in different ways. All partings of up to five
    languages; beyond, of some random choices the one whose closest rows are furthest apart."""
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= 5:
        columns = [[1, *(c >> i & 1 for i in range(languages - 1))] for c in range(2 ** (languages - 1) - 1)]
        return np.array(columns, np.int8).T
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, apart = None, -1
    for _ in range(64):
        bits = rng.integers(0, 2, (languages, length), np.int8)
        if (bits.sum(axis=0) % languages == 0).any():
            continue
        signs = 2.0 * bits - 1
        distance = (length - (signs @ signs.T)) / 2 + length * np.eye(languages)
        if distance.min() > apart:
            best, apart = bits, distance.min()
    return best


@dataclass
class Model:
    languages: list[str]
    bits: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits
    settings: LanguageId
    middle: np.ndarray = None
    slope: np.ndarray = None
    trust: np.ndarray = None

    def margins(self, text: str) -> np.ndarray:
        counts = features(text, self.settings.orders, self.settings.slots)
        used = np.flatnonzero(counts)
        return counts[used].astype(np.float32) @ self.weights[used] / max(counts.sum(), 1)

    def decode(self, text: str | None) -> tuple[str, float, str | None]:
        """The language, its share among the codewords by loss (0 to 1), and the runner-up."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, None
        if len(self.languages) == 1:
            return self.languages[0], 1.0, None
        z = np.clip((self.margins(text) - self.middle) * self.slope, -8, 8)
        signs = 2.0 * self.bits - 1
        loss = np.log1p(np.exp(-signs * z)) @ self.trust
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        first, second = np.argsort(-share, kind="stable")[:2]
        return self.languages[first], float(share[first]), self.languages[second]


def _counted(docs: DataFrame, settings: LanguageId) -> DataFrame:
    """Rows (lang, slot, n) of `docs` (lang, text), added up in each task."""
    orders, slots, most = settings.orders, settings.slots, settings.most_languages

    def emit(sums: dict) -> pa.RecordBatch:
        parts = [(lang, np.flatnonzero(n), n) for lang, n in sums.items()]
        langs = [lang for lang, used, _ in parts for _ in range(len(used))]
        used = np.concatenate([u for _, u, _ in parts]) if parts else np.zeros(0, np.int64)
        n = np.concatenate([n[u] for _, u, n in parts]) if parts else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(used), pa.array(n)], ["lang", "slot", "n"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for rows in rows_of(batches):
            for lang, text in rows:
                if lang not in sums:
                    if len(sums) >= most:
                        yield emit(sums)
                        sums = {}
                    sums[lang] = np.zeros(slots, np.int64)
                if has_letter(text):
                    sums[lang] += features(text, orders, slots)
        yield emit(sums)

    return docs.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, settings: LanguageId = LanguageId()) -> Model:
    """The model of labelled `docs` (lang, text)."""
    mark = len(stored_since(0))
    taught = docs.where("lang IS NOT NULL").select("lang", "text")
    counts = stored(_counted(taught, settings), "counts")
    names = [r["lang"] for r in counts.select("lang").distinct().limit(settings.most_languages + 1).collect()]
    if len(names) > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} languages")
    languages = sorted(names)
    sums = np.zeros((len(languages), settings.slots))
    if languages:
        place = F.create_map(*(F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)))
        rows = counts.select(place[F.col("lang")].alias("i"), F.col("slot").cast("int"), "n").toPandas()  # at most one per place
        sums[rows["i"].to_numpy(np.int64), rows["slot"].to_numpy(np.int64)] = rows["n"]
    share = (sums + settings.smoothing) / (sums + settings.smoothing).sum(axis=1, keepdims=True)
    bits = codewords(len(languages))
    one = (bits.T @ share) / np.maximum(bits.sum(axis=0), 1)[:, None]
    zero = ((1 - bits).T @ share) / np.maximum((1 - bits).sum(axis=0), 1)[:, None]
    weights = np.log(one / zero).T.astype(np.float32) if bits.shape[1] else np.zeros((settings.slots, 0), np.float32)
    model = Model(languages, bits, np.ascontiguousarray(weights), settings)
    _tune(model, taught)
    release(docs.sparkSession, stored_since(mark))
    return model


def _tune(model: Model, taught: DataFrame) -> None:
    """Middle, slope and trust of each bit, from the margins of at most about `tuning` labelled texts."""
    n_bits = model.bits.shape[1]
    model.middle, model.slope, model.trust = np.zeros(n_bits), np.ones(n_bits), np.ones(n_bits)
    if not n_bits:
        return
    total = taught.count()
    part = F.lit(int(min(1.0, model.settings.tuning / max(total, 1)) * (1 << 20)))
    chosen = taught.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) <= part)
    shared = taught.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows in rows_of(batches):
            kept = [(lang, shared.value.margins(text)) for lang, text in rows if has_letter(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in kept], pa.string()), pa.array([k[1].tolist() for k in kept], pa.list_(pa.float32()))],
                ["lang", "m"])

    # Sums by language and bit are all that is needed: two passes of moments, no rows.
    each = chosen.mapInArrow(run, "lang string, m array<float>").select("lang", F.posexplode("m").alias("bit", "m"))
    sums = each.groupBy("lang", "bit").agg(
        F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"), F.var_pop("m").alias("var")).toPandas()
    place = {lang: i for i, lang in enumerate(model.languages)}
    for bit, rows in sums.groupby("bit"):
        is_one = model.bits[rows["lang"].map(place).to_numpy(np.int64), bit] == 1
        if not 0 < is_one.sum() < len(rows):
            continue
        mean, var = rows["mean"].to_numpy(float), rows["var"].to_numpy(float)
        high, low = mean[is_one].min(), mean[~is_one].max()  # the closest languages of both sides
        spread = np.sqrt(var.mean()) + 1e-6
        model.middle[bit] = (mean[is_one].mean() + mean[~is_one].mean()) / 2 if high <= low else (high + low) / 2
        model.slope[bit] = min(max(high - low, 0.1 * spread) / spread**2, 1e4)
        model.trust[bit] = min(max((high - low) / spread, 0.1), 4.0)
    model.trust /= model.trust.mean()


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score, runner_up, ambiguous)."""
    shared, limit = docs.sparkSession.sparkContext.broadcast(model), model.settings.ambiguous

    def run(batches):
        for rows in rows_of(batches):
            found = [shared.value.decode(r[1]) for r in rows]
            lang, score, second = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(second, pa.string()), pa.array([s < limit for s in score], pa.bool_())],
                ["doc_id", "lang_pred", "score", "runner_up", "ambiguous"])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, runner_up string, ambiguous boolean")
