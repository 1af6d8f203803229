import pytest

#: Texts that every operator must take: null, empty, spaces, marks, one word, many lines, long.
ODD = [None, "", " ", "...", "word", "a\n\n  b\t c ", "Grüße aus Köln, señor ▁ ﬁn 𝒳", "x" * 3000, "the cat sat on the mat " * 400]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with repeated rows, a null id and columns whose names clash with results."""
    rows = [(i, t, "en", "s", i) for i, t in enumerate(ODD)] + [(8, ODD[8], "en", "s", 8), (None, "no id here", None, None, None)]
    names = "doc_id long, text string, lang string, score string, n_tokens long"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
