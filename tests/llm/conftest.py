import pytest

ODD = [
    (1, "Plain words of a text, and more of them here.", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "fr", "b", 0),
    (4, "one", "de", "a", 3),
    (None, "A text without a key, in words.", "en", None, 2),
    (5, "Éléphant über ñandú 中文 🙂 </s> \\ [INST]", "es", "b", 9),
    (6, "Plain words of a text, and more of them here.", "en", "a", 1),
    (6, "Plain words of a text, and more of them here.", "en", "a", 1),
    (7, "12345 !!! ???", "en", "c", 4),
    (8, ("long words without end " * 3000).strip(), "en", "a", 5),
    (9, "x" * 30000, "en", "b", 6),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators might use themselves."""
    df = spark.createDataFrame([(*r, 7, "k", 0) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, row int, key string, size int")
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)
