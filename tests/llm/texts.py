"""Invented prose for tests."""

import random

SYLLABLES = "an be co da el fo gi ha in jo ka lu me no or pa qui ra so tu ve wi xo ya zu".split()


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words)
