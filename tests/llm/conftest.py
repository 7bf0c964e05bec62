"""Documents with every awkward case: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Rows with copies, near copies, shared passages, nulls, empty and very long texts."""
    rng = random.Random(11)
    base = prose(rng, 120)
    words = base.split(" ")
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(0, base, "en", "a", 1), (1, base, "en", "b", 1), (2, base.upper(), "en", "b", 1)]
    for i in range(3, 9):  # near copies, some too far
        w = list(words)
        for _ in range(i - 2):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9999)}"
        rows.append((i, " ".join(w), "en", None if i % 3 == 0 else "a", 1))
    rows += [(i, f"{prose(rng, 60)} {passage} {prose(rng, 30)}", "fr", "c", 1) for i in range(9, 16)]
    rows += [(20, None, None, None, None), (21, "", "en", "a", 0), (22, " \t\n", "en", "a", 3), (23, "two words", "en", "a", 9), (24, "two  words", "de", "b", 10), (25, "Two\tWORDS", "de", "b", 9)]
    rows += [(30, prose(rng, 9000), "en", "a", 1), (31, "x" * 5000, "en", "d", 1), (32, "ab" * 400, "en", "d", 1), (33, "é" * 300 + " ünïcode " * 40, "de", "d", 1)]
    rows += [(None, passage, "en", "a", 1), (None, base, "en", "a", 1), (40, passage, "en", "a", 1), (40, passage, "en", "a", 1), (41, "z " * 200, "en", "b", 1)]
    return rows


@pytest.fixture()
def documents(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)
