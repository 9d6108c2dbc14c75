import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, found string, block int, fp double, score string, weight string"


def words(rng, n):
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    return ["".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def messy_rows():
    """Ids that are null or repeat, texts that are null, empty, blank, very long or without white space."""
    rng = random.Random(11)
    shared = " ".join(words(rng, 60))
    long = " ".join(words(rng, 60_000))
    texts = [
        (7, shared), (3, "Intro " + shared + " outro"), (9, shared), (9, shared), (None, shared), (None, None),
        (1, None), (2, ""), (4, " \t\n \x0b\x0c"), (5, "one"), (6, "a b"), (8, long), (10, long + " end"),
        (11, "x" * 70_000), (12, "été ça   va　bien  fin"), (13, "<|endoftext|> a<|endoftext|>b"),
        (14, "tab\tsep\n\nnew  line \r\n end"), (15, shared.upper()), (-4, "negative id " + shared), (16, "퟿ \U0001f600 ok"),
    ]
    more = [(100 + k, " ".join(words(rng, rng.randint(1, 80)))) for k in range(30)]
    return [
        (i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None, "f", k, 0.5, "s", None)
        for k, (i, t) in enumerate(texts + more)
    ]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
