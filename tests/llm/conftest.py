import random

import pytest

#: Names that operators use inside; a table may have them too.
CLASHING = ("i", "t", "k", "n", "th", "node", "keys", "block", "bucket", "c0", "_k", "_i", "_ranges", "score", "kept")


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the cat sat on a mat while two dogs ran over green hills and rivers near old stone walls of great age".split()) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    base = words(rng, 80)
    rows = [(n, words(rng, rng.randint(1, 120)) + ".", "en") for n in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "  \n\t ", "fr"), (None, "a null id has a text too. it is here.", None), (None, None, None)]
    rows += [(103, base, "en"), (104, base, "en"), (103, base, "en"), (105, base + " and more", "en"), (106, base, None)]
    rows += [(107, "word " * 60_000, "en"), (108, "x" * 300_000, "en"), (109, "é ß 你好 😀   \x1c", "de"), (110, "\n\n\n", "en"), (111, "1 2 3 !!", "en")]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    """The rows as a table with clashing columns beside its own."""
    extra = ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame([(*r, *[7] * len(CLASHING)) for r in odd_rows], f"doc_id long, text string, lang string, {extra}")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
