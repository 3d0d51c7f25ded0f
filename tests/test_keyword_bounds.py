"""Word boundaries of keyword patterns against those of Python."""

import random
import re

from folioguard.operators.classify import ascii_bounds
from folioguard.rules import CLASSIFICATION

ODD = [r"\bA?B\b", r"\bÄB\b", r"\b(?:A?|B)C\b", r"\b(?:AB|(?:C|D)E)F", r"\b(?:AB)?\s*C\b", r"\b<A", r"\bA+\b|\bB", r"A\b \bB", r"\bA{2}\b"]


def test_boundaries_are_those_of_ascii():
    rng = random.Random(3)
    patterns = [p for _, words in CLASSIFICATION for _, p, _ in words] + ODD
    for pattern in patterns:
        mine, plain = re.compile(ascii_bounds(pattern)), re.compile(pattern.replace(r"\s", r"[ \t\n\r\f\v]"), re.ASCII)
        words = [w for w in re.findall("[A-ZÄÖÜ]+", re.sub(r"\\.", " ", pattern)) if w]
        for _ in range(400):
            text = "".join(rng.choice([*words, *words, " ", "-", "Ä", "x", "_", "9", "<", "A", "AA", "B", "O", "N", "D", "ID"]) for _ in range(rng.randint(1, 7)))
            assert bool(mine.search(text)) == bool(plain.search(text)), (pattern, text)
