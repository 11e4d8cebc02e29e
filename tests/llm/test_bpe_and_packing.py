import base64
import hashlib
import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from feedrank.llm import bpe, packing, queries, token_shards, tokens
from feedrank.llm.chunks import pieces
from llm.prose import prose

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@cache
def reference(path=RANKS):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def tokenizer():
    model = Tokenizer.from_file(JSON)
    model.encode_special_tokens = True
    return model


def plain_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_merging_by_rank():
    rng, encoding = random.Random(3), reference()
    _, encoder = bpe.load(RANKS)
    texts = ["".join(rng.choice("abcdeéüñ日本ß .,!x\n\t0") for _ in range(200)) for _ in range(300)]
    texts += ["a" * 3000, "=" * 700, "  lead", "trail ", "x\n\ny", "don't it's 'll", "a\x00b", "\x1c \x1d", "\n", " "]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoding.encode_ordinary(text)


def test_a_small_memory_changes_nothing():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own, encoding = bpe.BacktrackingBpe(ranks, limit=2), reference()
    for text in ("the cat sat on the unbelievable mat", "antidisestablishmentarianism zzzz"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == encoding.encode_ordinary(text)


def test_chunks_join_to_the_text():
    assert pieces("a b\nc d") == ["a", " b", "\n", "c", " d"]
    assert pieces("a  b") is None and pieces(" a") is None and pieces("a\n") is None


def test_ids_are_those_of_tokenizers(odd_texts):
    encode, _ = tokens.load(JSON)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeéüñ日本ß .,!x\n\t0'😀") for _ in range(200)) for _ in range(300)]
    texts += ["it's a\tb c.\nEnd, of 12,5!", "<|endoftext|> is text", "a \n b", "a" * 3000, " " * 9000 + "x", "\x00", ""]
    for text in [*texts, *filter(None, odd_texts)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain_ids(text)[:-1]
    assert tokens.ranks_of(public_tokenizers.path("word_bpe_49k.json")) is None


def test_query_encodes_and_decodes_odd_texts(odd_docs):
    encoding = reference()
    rows = bpe.encode_decode(odd_docs, RANKS).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    assert len(rows) == len(texts)
    expected = sorted((str(d), np.array(encoding.encode_ordinary(t), "<u4").tobytes(), t.encode()) for d, t in texts)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in rows) == expected


def check_pieces(rows, texts, size):
    """Each id in exactly one piece, sequences gapless and within size; returns their lengths."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for key, parts in by_doc.items():
        ids, at = np.array(plain_ids(texts[key]), "<u4"), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    lengths = []
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        lengths.append(at)
    return lengths


def test_packing_covers_every_id_with_little_padding(make_docs, rng, odd_texts):
    texts = [*odd_texts[:7], *odd_texts[8:], *(prose(rng, rng.randint(1, 900)) for _ in range(150))]
    docs = make_docs(texts)
    lengths = check_pieces(packing.pack(docs, JSON).collect(), dict(enumerate(texts)), 2048)
    assert sum(packing.padding(n, 2048) for n in lengths) < 0.02 * sum(lengths)
    small = packing.Packing(size=64, block=500, undecided=2)
    lengths = check_pieces(packing.pack(docs, JSON, small).collect(), dict(enumerate(texts)), 64)
    assert sum(packing.padding(n, 64) for n in lengths) < 0.2 * sum(lengths)


def test_streams_of_any_length_are_packed(spark):
    """Streams of no ids, one, about a sequence, and whole sequences, in one block and in several."""
    def text(ids):  # with the end id
        return " ".join(["the"] * (ids - 1))

    assert [len(plain_ids(text(n))) for n in (1, 2, 2047, 2048)] == [1, 2, 2047, 2048]
    for size, lengths in ((2048, (1, 2047, 2048, 2049, 4096)), (64, (1, 63, 64, 65, 128, 640))):
        for n in lengths:
            for parts in ([n], [1] * min(n, 130), [n - n // 2, n // 2] if n > 1 else [1], [n, size, n]):
                texts = {i: text(m) for i, m in enumerate(parts)}
                docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
                for block in (1 << 20, size):
                    found = packing.pack(docs, JSON, packing.Packing(size=size, block=block, undecided=1)).collect()
                    check_pieces(found, texts, size)
    empty = spark.createDataFrame([(0, "the the")], "doc_id long, text string").repartition(8)
    check_pieces(packing.pack(empty, JSON).collect(), {0: "the the"}, 2048)


def test_cuts_cost_the_least(rng):
    def brute(places, penalties, size):
        best = {0: 0}
        for j in range(1, len(places)):
            best[j] = penalties[j] + min(
                best[i] + packing.padding(places[j] - places[i], size)
                for i in range(j) if places[j] - places[i] <= size)
        return best[len(places) - 1]

    for _ in range(200):
        size = rng.choice([8, 16, 32])
        places = np.cumsum([0, *(rng.randint(1, size) for _ in range(rng.randint(1, 40)))])
        penalties = np.array([rng.choice([0, 1, 5]) for _ in places])
        cuts = packing.choose_cuts(places, penalties, size)
        cost = sum(penalties[j] + packing.padding(int(places[j] - places[i]), size) for i, j in zip(cuts, cuts[1:]))
        assert cost == brute(places.tolist(), penalties.tolist(), size)


def test_packing_of_odd_and_no_documents(odd_docs, no_docs):
    assert packing.pack(no_docs, JSON).count() == 0
    rows = packing.pack(odd_docs, JSON).collect()
    assert {r["doc_id"] for r in rows} == {*range(14), None}
    assert sum(r["length"] for r in rows) == sum(len(plain_ids(r["text"])) for r in odd_docs.collect())


def test_permutation_is_one_to_one_and_turns_back():
    for total in (1, 2, 3, 7, 100, 1025, 4097):
        numbers = np.arange(total)
        slots = token_shards.permuted(numbers, total, key=99)
        assert sorted(slots.tolist()) == numbers.tolist()
        assert token_shards.permuted(slots, total, key=99, back=True).tolist() == numbers.tolist()
    assert token_shards.permuted(np.arange(50), 50, 1).tolist() != token_shards.permuted(np.arange(50), 50, 2).tolist()


def test_shards_hold_every_sequence_at_its_slot(spark, make_docs, rng, odd_texts, tmp_path):
    texts = [*odd_texts, *(prose(rng, 300) for _ in range(20))]
    shards = token_shards.Shards(size=64, per_shard=32)
    made = token_shards.sequences(make_docs(texts), JSON, shards)
    pieces_ = made.cache()
    path = str(tmp_path / "shards")
    token_shards.write(pieces_, path, shards)
    total = pieces_.count()
    rows = token_shards.read(spark, path, shards).collect()
    assert sorted(r["slot"] for r in rows) == list(range(total)) and all(r["intact"] for r in rows)
    every = {d: np.array(plain_ids(t), "<u2") for d, t in enumerate(texts)}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u2")
        own = every[r["doc_id"]][r["start"] : r["start"] + len(ids)]
        assert ids[: len(own)].tolist() == own.tolist()
    assert sum(r["n_ids"] for r in rows) == sum(map(len, every.values()))
    part = token_shards.read(spark, path, shards, shard=1, first=30).collect()
    assert sorted(r["slot"] for r in part) == list(range(62, 64))
    assert token_shards.unfinished(spark, path, total, shards) == []
    lost = next((tmp_path / "shards" / "shard=1").glob("part-*"))
    lost.unlink()
    assert token_shards.unfinished(spark, path, total, shards) == [1]
    token_shards.write(pieces_, path, shards, only=[1])
    assert token_shards.unfinished(spark, path, total, shards) == []
    pieces_.unpersist()


def test_shards_of_odd_and_no_documents(spark, odd_docs, no_docs, tmp_path):
    shards = token_shards.Shards(size=512, per_shard=8)
    made = token_shards.sequences(no_docs, JSON, shards).cache()
    token_shards.write(made, str(tmp_path / "none"), shards)
    assert made.count() == 0 and token_shards.read(spark, str(tmp_path / "none"), shards).count() == 0
    assert token_shards.read(spark, str(tmp_path / "missing"), shards).count() == 0
    made = token_shards.sequences(odd_docs.coalesce(1), JSON, shards).cache()
    token_shards.write(made, str(tmp_path / "odd"), shards)
    rows = token_shards.read(spark, str(tmp_path / "odd"), shards).collect()
    assert sum(r["n_ids"] for r in rows) == sum(len(plain_ids(r["text"])) for r in odd_docs.collect())
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and all(r["intact"] for r in rows)
    alone = token_shards.sequences(odd_docs.where("doc_id IS NULL"), JSON, shards).cache()
    token_shards.write(alone, str(tmp_path / "alone"), shards)
    assert [r["doc_id"] for r in token_shards.read(spark, str(tmp_path / "alone"), shards).collect()] == [None]


def test_registered_digests(spark, tmp_path, make_docs):
    make_docs(["one two", None]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op8_bpe(spark, str(tmp_path)).collect()}
    assert rows[1]["n_tokens"] == 0 and rows[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[0]["decoded_sha256"] == hashlib.sha256(b"one two").hexdigest()
