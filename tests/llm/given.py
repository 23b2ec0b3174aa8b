import random

import pytest
from brute import DOCS

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, one long word, ties and repeated rows."""
    return [
        (1, "Plain words, here and there; and more of them follow.\nSecond line", "en", "a", 10),
        (1, "Plain words, here and there; and more of them follow.\nSecond line", "en", "a", 10),
        (1, "another text under the same number\nwith a line", "en", "a", 10),
        (2, None, "en", "a", 0),
        (3, "", None, None, None),
        (4, " \n\t ", "en", "a", 3),
        (5, "42 17 -- !!", "en", "a", 11),
        (None, "no number at all, but a text with enough words to matter", "en", None, 1),
        (None, None, None, None, None),
        (6, LONG, "en", "a", len(LONG)),
        (7, "z" * 30_000, "de", "a", 30_000),
        (8, "Größe und Straße, naïve café — 中文字 العربية <|endoftext|> it's\x1cdone", "de", "b", 5),
        (9, "one", "fr", "b", 3),
        (10, "one", "fr", "b", 3),
    ]


@pytest.fixture
def frame(spark):
    return lambda rows, schema=DOCS: spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def sentences():
    draw = random.Random(5)
    stock = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 7))) for _ in range(400)]
    return lambda n: " ".join(draw.choices(stock, k=n))
