import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, node int, size string, copies int, toxic string, __extra string, __score string, __found string, __id long, __a string, __one string"


def words(seed: int, n: int) -> list[str]:
    """Invented words, the same for the same seed."""
    return [f"w{(seed * 7919 + k * 104729) % 100003}x" for k in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with NULLs, empty and long texts, ties, repeated rows and columns named like the operators' own."""
    base = " ".join(words(1, 80))
    near = base.replace(words(1, 80)[40], "other")
    texts = [
        (1, base, "a"), (2, base, "a"), (3, near, "b"), (4, None, "a"), (5, "", None), (None, "one two three", "b"), (6, "short", "c"),
        (7, " ".join(words(2, 30_000)), "a"), (8, "x\n\n y\t z", None), (9, "Idiot! " + " ".join(words(3, 50)), "b"), (10, " ".join(words(4, 60)), "c"),
        (10, " ".join(words(4, 60)), "c"), (11, "!!! ??? ***", "b"), (12, "é ü ñ 漢字 émile", "a"), (None, None, None),
    ]
    rows = [(i, t, "en", s, None, "s", 1, "z", 2, None, "e", "p", "f", 3, "a", "o") for i, t, s in texts]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
