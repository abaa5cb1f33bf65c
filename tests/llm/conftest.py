import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, count string, root string, _score string"


def row(i, text):
    return (i, text, "en", "s", None if text is None else len(text), "k", "f", "c", "r", "x")


def texts():
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "Eta", "theta"]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(n))
    base = [make(rng.randint(1, 120)) for _ in range(12)]
    passage = make(60)
    return [*base, base[0], base[0], base[1] + " more", passage + base[2], base[3] + passage, "x" * 3000, "ab" * 400, "", "   \n", "one", "two words", make(4000)]


@pytest.fixture(scope="session")
def edge_rows():
    """Rows with nulls, empty and long texts, repeated rows and extra columns."""
    rows = [row(i, t) for i, t in enumerate(texts())]
    return [*rows, row(None, "no id here"), row(None, None), row(500, None), row(0, rows[0][1]), row(7, "another text of id seven")]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
