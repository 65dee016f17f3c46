import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "ash birch cedar dogwood elm fir gum hazel ivy juniper kauri larch maple nutmeg oak pine".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows and a column that clashes with inner names."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base + " extra", "en", "a", 1),
        (4, None, "en", "b", None),
        (5, "", None, "b", 0),
        (6, "   \n\t ", "en", None, 5),
        (7, "one", "en", "c", 3),
        (7, "one", "en", "c", 3),
        (8, prose(2, 6000) + "\n" + prose(3, 60), "en", "c", 1),
        (9, "é ü " * 40 + "\nsame line\nsame line\n\n", "fr", "a", 1),
        (10, prose(4, 60) + "\x00\x85 \U0001f600 tail", "en", "d", 1),
        (None, prose(5, 70), "en", "a", 1),
        (12, "spam " * 100, "en", "d", 1),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("host", "fp", "bucket", "kept", "score", "component_id", "n_words"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
