"""The ids of whole texts by a `tokenizers` file of byte-level BPE.

Where the file's ids follow the order of its merges, and it changes and splits texts in the plain
byte-level way, applying merges by order and by id is the same, and `tiktoken` gives the ids of `tokenizers` in a
fraction of the time; the file's own vocabulary is handed to it. Other files, and texts with very long runs of
white space, go through `tokenizers` itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken

_LONG_GAP = re.compile(r"\s{4096}")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, the other way round: printable Latin-1
    stands for itself, the other bytes are numbered on from 256 in their order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks if ids and merges have the same order and nothing else is done to texts; else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and spec.get("normalizer") is None and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    vocab = model.get("vocab", {})
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    letters = byte_letters()
    return {bytes(letters[c] for c in token): rank for token, rank in vocab.items() if rank < 256 + len(merges)}


@cache
def load(path: str) -> tuple[Callable[[str], bytes], np.ndarray]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers, and for each id whether it ends
    a sentence or a line. Once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    ends = np.zeros(model.get_vocab_size(), dtype=bool)
    for i in range(len(ends)):
        ends[i] = model.decode([i], skip_special_tokens=False).endswith((".", "!", "?", "\n"))

    def slow(text: str) -> bytes:
        return np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    ranks = ranks_of(path)
    if ranks is None:
        return slow, ends
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if _LONG_GAP.search(text):
            return slow(text)
        return quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    return encode, ends
