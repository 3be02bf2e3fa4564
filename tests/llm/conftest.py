import pytest

#: Nulls, empties, ties, repeated rows, a long text, an extra column with a clashing name.
TEXTS = ["a b c d e f g h", "A B C D E F G H", "a b c d e f g h", "", None, " \n\t ", "one two", "x " * 3000, "é ü ß, no. yes!", "a b c d e f g i"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "s", 0 if t is None else len(t), "clash") for i, t in enumerate(TEXTS)]
    rows += [(3, "", "en", "s", 0, "clash"), (None, "one two", "en", "s", 7, "clash"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
