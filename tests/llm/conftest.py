import random

import pytest

WORDS = "the of and to in is that it was for on are as with his they at be this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words, a line about every 12."""

    def make(seed, n):
        r = random.Random(seed)
        out = []
        for i in range(n):
            out.append(r.choice(WORDS))
            out.append("\n" if i % 12 == 11 else " ")
        return "".join(out).strip()

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Documents with nulls, ties, repeated rows, empty and long texts, and columns whose names operators use inside."""
    long = prose(1, 6000)
    rows = [
        (1, prose(2, 80), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "   \n\n ", "en", "b", 6), (5, prose(2, 80), "en", "b", 1), (5, prose(2, 80), "en", "b", 1),
        (6, long, "de", "a", 1), (7, long + " end", "de", "a", 1), (8, "é中\U0001f600 Kelvin MIT License", "fr", "a", 9), (None, prose(3, 60), "en", "c", 1), (9, "word", "en", "a", 4), (10, "# " * 50, "en", "a", 100),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS digest", "1 AS rows", "2 AS class_id", "'y' AS held_out", "3 AS n_tokens_")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
