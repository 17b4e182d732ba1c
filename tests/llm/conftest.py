"""Small tables with the awkward cases every operator must stand."""

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, part string, of long, row int, size long"


def document(doc_id, text, source="src"):
    """A row of documents with further columns whose names the operators use themselves."""
    return (doc_id, text, "en", source, len(text or ""), "x", 7, 1, 9)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([document(*r) for r in rows], COLUMNS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source): nulls, empty, blank, very long, copies, near copies, ties,
    rows that repeat, non-ASCII."""
    rng = random.Random(5)
    words = ["the", "of", "and", "Élan", "été", "house", "river", "stone", "cloud", "paper", "green", "to"]
    words += ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, long = text(120), text(6000)
    near = base.split()
    near[5] = "changed"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, "", "b"), (5, None, None),
        (6, "   \t\n ", "c"), (7, long, "a"), (8, long[: len(long) // 2] + text(50), "c"),
        (9, "one", "c"), (10, "One", "c"), (11, "!!! ??? ...", "d"), (12, "a" * 400, "d"),
        (13, "ÀÉÎ ça и 漢字 \U0001f600 " * 12, "d"), (14, base.upper(), "a"),
    ]
    return rows + [(20 + i, text(rng.randint(1, 200)), rng.choice("abc")) for i in range(25)]
