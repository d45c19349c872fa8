"""Random prose for the tests of this folder."""

import random

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "le", "mi") for b in ("r", "nt", "lo", "sk", "va", "pe", "zu", "tion")]


def prose(rng: random.Random, n: int, per_line: int = 12) -> str:
    words = [rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i: i + per_line]) for i in range(0, n, per_line))
