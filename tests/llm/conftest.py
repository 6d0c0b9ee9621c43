import random

import pytest

SCHEMA = "doc_id long, text string, lang string, id long, words string, block int, seed string"


def sentence(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, nulls, empty, repeated and long rows."""
    rnd = random.Random(3)
    texts = {i: sentence(rnd, rnd.randrange(3, 90)) for i in range(40)}
    for i in range(40, 60):
        words = texts[i - 40].split()
        words[rnd.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    texts |= {60: texts[5], 61: texts[5].upper(), 62: "", 63: None, 64: "  \t\n ", 65: "one two", 66: "One TWO", 67: sentence(rnd, 6000)}
    rows = list(texts.items()) + [(None, texts[5]), (None, None), (7, texts[7])]
    return [(i, t, "xx", 1, "clash", 2, "clash") for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
