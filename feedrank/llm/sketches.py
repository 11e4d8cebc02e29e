"""Bottom-k sketches of shingle hashes: mergeable fingerprints of documents.

A sketch is the ascending array of the k smallest distinct 64-bit hashes (unsigned order) of a text's word
shingles. The sketch of a union is the k smallest of both sketches together, so parts of a text or a
corpus can be sketched apart and merged. Over the k smallest of the union, the share that lies in both
sketches estimates resemblance; the k-th smallest hash estimates the number of distinct shingles;
together they estimate containment. Everything is DataFrame expressions.

Defined results: a null or blank text has the empty sketch, which equals itself (resemblance 1) and
shares nothing with others (0); a text with fewer words than a shingle is one shingle; repeated shingles
count once; equal texts have equal sketches; with fewer than k hashes every estimate is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedrank.llm.common import stored, words

K = 128
SHINGLE = 5
#: Flips the highest bit: signed order of the result is unsigned order of the hash.
_FLIP = -(1 << 63)


def hashes(word_array: Column, shingle: int = SHINGLE) -> Column:
    """The hash of every shingle of an array of words, repeats included."""
    starts = F.slice(word_array, 1, F.greatest(F.size(word_array) - (shingle - 1), F.least(F.size(word_array), F.lit(1))))
    return F.transform(starts, lambda word, i: F.xxhash64(word, *(F.get(word_array, i + n) for n in range(1, shingle))))


def bottom(hash_array: Column, k: int = K) -> Column:
    """The sketch of an array of hashes, as signed longs in the order of the unsigned hashes."""
    flipped = F.transform(F.array_distinct(hash_array), lambda h: h.bitwiseXOR(F.lit(_FLIP)))
    return F.slice(F.sort_array(flipped), 1, k)


def sketch(word_array: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    return bottom(hashes(word_array, shingle), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(df: DataFrame, keys: list[str], sketch_column: str, k: int = K) -> DataFrame:
    """The sketch of each group: of every group only the k smallest hashes are gathered, after each
    task has dropped what cannot be among them."""
    each = df.select(*keys, F.explode(sketch_column).alias("h")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    smallest = each.withColumn("place", place).where(F.col("place") <= k)
    return smallest.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketch_column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated Jaccard similarity of the two sets of shingles."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared.cast("double") / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below k."""
    kth = F.get(a, k - 1).cast("double") + F.lit(2.0**63)  # of 2**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * 2.0**64) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has, 0 to 1."""
    similar, own, other = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    common = similar / (1 + similar) * (own + other)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(common / own, F.lit(1.0)))


def digits(a: Column) -> Column:
    """A sketch as text: 16 hex digits per hash, smallest hash first."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h.bitwiseXOR(F.lit(_FLIP))), 16, "0")), ""))


def with_next(docs: DataFrame, parts: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, text, next_text): the text of the next row by ascending doc_id (ties by text), of
    the first row after the last; null texts are empty.

    Ids are dealt to `parts` ranges of similar size and every range is put in order by itself; the first
    row of each range, at most `parts` rows, follows the last one of the range before.
    """
    rows = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    shares = [i / parts for i in range(1, parts)]
    cuts = []
    if shares:
        found = rows.agg(F.percentile_approx("doc_id", shares, max(10000, 10 * parts)).alias("p")).first()["p"]
        cuts = sorted(set(found or ()))
    bounds = F.array(*map(F.lit, cuts)).cast("array<long>")
    # As many bounds as are at most the id: a place by halving, written as the size of a filter.
    place = F.coalesce(F.size(F.filter(bounds, lambda bound: bound <= F.col("doc_id"))), F.lit(0))
    dealt = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place))
    order = Window.partitionBy("part").orderBy("doc_id", "text")
    led = dealt.select(
        "part", "doc_id", "text", F.lead("text").over(order).alias("next_text"),
        (F.row_number().over(order) == 1).alias("is_first"), F.lead(F.lit(1)).over(order).isNull().alias("is_last"))
    firsts = _firsts(dealt, parts)
    return led.join(firsts, (led["part"] == firsts["before"]) & led["is_last"], "left").select(
        "doc_id", "text", F.coalesce("next_text", "first_text", F.lit("")).alias("next_text"))


def _firsts(dealt: DataFrame, parts: int) -> DataFrame:
    """Rows (before, first_text): for each range that has rows the first text of the one after it, in a ring."""
    ids = dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("m"))
    known = ids.select("part", "m.has", "m.doc_id").limit(parts + 1).collect()
    known = sorted((r["part"], r["has"], r["doc_id"]) for r in known)
    before = [known[i - 1][0] for i in range(len(known))]
    schema = "before int, own int, id long"
    ring = dealt.sparkSession.createDataFrame(
        [(b, part, doc_id if has else None) for b, (part, has, doc_id) in zip(before, known)], schema)
    same = (dealt["part"] == ring["own"]) & dealt["doc_id"].eqNullSafe(ring["id"])
    return dealt.join(F.broadcast(ring), same).groupBy("before").agg(F.min("text").alias("first_text"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half of code points (rounded down) replaced by the first as many of `following`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
