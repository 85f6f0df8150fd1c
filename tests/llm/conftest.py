import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, row long, digest string, keep_id string, score string, label string, node string, n long, at string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns whose names the operators use inside."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, 1, "d", "k", "s", "l", "n", 2, "a") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, very long, equal up to case, repeated; null ids."""
    dice = random.Random(9)
    words = ["".join(dice.choices("abcdeé", k=dice.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(dice.choices(words, k=n))
    base = prose(80)
    return [
        (1, base), (2, None), (3, ""), (4, base.upper().replace("É", "é")), (5, base), (5, base), (6, " \n\t "), (7, "word"), (8, "two words"),
        (9, prose(60000)), (None, prose(20)), (None, None), (10, base + " tail"), (11, prose(200)), (12, "x" * 3000), (13, "Ünï 中文 🙂 " * 40),
    ]
