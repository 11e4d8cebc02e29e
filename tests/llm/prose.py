"""Made-up prose for the tests."""

import random

SYLLABLES = ("ba", "ke", "mi", "no", "ru", "ta", "lo", "shi", "ven", "dor")


def prose(rng: random.Random, words: int, per_line: int = 12) -> str:
    made = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words)]
    lines = [" ".join(made[i : i + per_line]) + "." for i in range(0, words, per_line)]
    return "\n".join(lines)
