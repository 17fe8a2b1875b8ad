import random

import pytest

SF_SMALL = "/root/testdata/sf0.001"


def prose(seed: float, n: int) -> str:
    """n words that another seed hardly makes again."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    long = prose(1, 30_000)
    rows = [
        (1, None, "a"), (2, "", None), (3, " \t\n ", "a"), (4, long, "b"), (4, long, "b"), (5, prose(2, 120), "b"),
        (None, prose(2, 120), "b"), (None, None, None), (6, prose(2, 120), "a"), (7, "one two", "a"), (8, "x" * 200_000, "a"),
        (9, "\\ <|turn|> \\| <|", "b"), (10, "same same same same " * 40, None), (11, prose(3, 80) + ".", "a"),
    ]
    clash = "1L AS size, 'x' AS shard, true AS kept, 2 AS slot, 3 AS label, 'y' AS bucket, 4 AS n_words, 5 AS score, 'z' AS text_key"
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars", *clash.split(", "))
