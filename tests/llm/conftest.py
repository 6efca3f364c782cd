import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(3)
    long_text = prose(rng, 30_000, 5000)
    base = prose(rng, 120)
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, "b", 4),
        (4, "one", "de", None, 3),
        (5, "one two", "de", "b", 7),
        (6, long_text, "en", "a", len(long_text)),
        (7, base, "en", "a", len(base)),
        (8, base, "en", "c", len(base)),
        (9, base.upper(), "fr", "a", len(base)),
        (10, base + " tail", "en", "a", len(base) + 5),
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
        (7, base, "en", "a", len(base)),
        (7, base, "en", "a", len(base)),
        (7, prose(rng, 90), "en", "a", 9),
        (11, "Ünïcödé 你好 \x00 zero\x85width​ 🎉 words İ", "es", "d", 9),
    ]
    rows += [(100 + i, prose(rng, rng.randrange(1, 200)), rng.choice(["en", "fr"]), rng.choice("abc"), i) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
