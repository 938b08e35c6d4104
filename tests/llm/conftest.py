import pytest

LONG = "lorem ipsum dolor sit amet " * 20000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, "x"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a", 43, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", "b", 0, "x"),
    (5, LONG, "en", "b", len(LONG), "x"),
    (6, "eins zwei drei vier fünf", "de", None, 24, "x"),
    (None, "an identifier is missing here", "en", "c", 29, "x"),
    (7, "un deux trois", "fr", "c", 13, None),
    (7, "un deux trois", "fr", "c", 13, None),  # a repeated row
    (8, " \n\t ", None, "a", 4, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeats, and extra columns whose names the operators use."""
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, digest string, size string, n string, at string, key string"
    return spark.createDataFrame([(*r, *[r[-1]] * 5) for r in ROWS], kind)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
