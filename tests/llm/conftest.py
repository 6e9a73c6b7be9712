import random

import pytest

#: Columns that clash with what operators add; doc_id, text, lang, source, n_chars are the table's own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, slot string, c0 string, label string, bucket string, piece string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(3, 8))) for _ in range(n))


def rows(*pairs, lang="en"):
    return [(i, t, lang, "src0", None if t is None else len(t), "x", None, "y", "z", None, "b", "p") for i, t in pairs]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls everywhere, an empty and a very long text, ties and repeated rows, extra columns with clashing names."""
    base = words(1, 60)
    pairs = [(1, base), (1, base), (2, base), (3, None), (4, ""), (5, "  \n "), (6, "123 !!"), (None, base + " x"), (None, None), (7, words(2, 30_000)), (8, "one"), (9, "Été ça, naïve."), (10, base.replace(" ", "  ")), (11, base)]
    return spark.createDataFrame(rows(*pairs), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
