"""Tables with every oddity that the operators must bear; imported as fixtures."""
import pytest

LONG = "word salad with many parts " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    rows = [(1, "the quick brown fox jumps over the lazy dog " * 3), (2, "the quick brown fox jumps over the lazy dog " * 3), (3, None), (4, ""),
            (5, " \n\t "), (6, "one"), (7, LONG), (8, LONG + "tail"), (9, "été à 37 km\nΣίσυφος 中文 <|endoftext|> ▁x"), (None, "the quick brown fox jumps over it"),
            (10, "one"), (11, "ONE"), (6, "one"), (-3, "a.b,c!")]
    names = ("k", "core", "n", "part", "rank", "component", "label", "salt", "lang")
    kind = "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame([(*r, *("x" for _ in names)) for r in rows], kind).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
