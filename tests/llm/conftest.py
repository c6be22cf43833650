import random

import pytest

from conftest_words import words

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, and columns of other tables.
EXTRA = "row_key long, shard long, place double, at long, bucket long, score double, query string, ids string, copy int, key long"


@pytest.fixture(scope="session")
def documents(spark):
    """Build documents from texts, or from (id, text) pairs."""

    def build(rows, lang=None, source="s"):
        pairs = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        full = [(i, t, lang[k] if lang else "en", source if isinstance(source, str) else source[k], len(t or ""))
                for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(full, DOCUMENT)

    return build


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty and long texts, repeated rows and ids, and columns whose names may clash."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    own = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id but some words here", "en", None, 9), (None, None, None, None, None),
        (3, "the same words in two rows", "en", "s", 1), (3, "the same words in two rows", "en", "s", 1),
        (3, "one id with another text", "de", "t", 1), (4, " \n\t ", "en", "t", 3), (5, long, "en", "s", len(long)),
        (6, "12345 67890", "en", "s", 11), (7, "ünï çödé 🙂🙂🙂🙂 wörds", "de", "t", 5), (8, "🙂", "de", "t", 1),
    ]
    extra = (0, 0, 0.5, 0, 0, 0.5, "q", "i", 7, 0)
    return spark.createDataFrame([row + extra for row in own], f"{DOCUMENT}, {EXTRA}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"{DOCUMENT}, {EXTRA}")
