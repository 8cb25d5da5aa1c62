"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeats, clashing column names."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, score double, class_id string, label int"


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(20, 60)) + "." for _ in range(30)]
    near = []
    for t in base[:6]:
        words = t.split()
        for k in range(3):
            copy = list(words)
            copy[k] = "changed"
            near.append(" ".join(copy))
    return base + near + [base[0], base[0], base[1].upper(), "one", "two words", "One!", "???", "", "", None, None, "äöü É ñ" * 3]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "en", "s", 0.5, "x", 1) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (3, "the same id with another text " * 3, None, None, None, None, None), (None, texts[5], None, None, None, None, None)]
    rows.append((10_000, sentence(random.Random(9), 30_000), "en", "s", 1.0, "y", 0))
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
