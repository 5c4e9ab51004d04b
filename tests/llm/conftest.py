import re

import pytest

SEPARATED = re.compile(r"[^\x20\x09-\x0D]+")

# nulls, empty and blank texts, ties, repeated rows, a long text; columns that clash with inner names
AWKWARD = [
    (1, "alpha beta gamma delta", "en", "a"), (2, "alpha beta gamma delta", "en", "a"), (2, "alpha beta gamma delta", "en", "a"),
    (3, None, None, None), (None, "", "en", None), (None, None, None, "a"), (4, " \t\n\x0b ", "de", "b"), (5, "one", "en", "b"),
    (5, "one", "en", "c"), (6, "Straße  über▁ <|endoftext|> ÄÖ", None, "c"), (7, "word " * 40000, "en", "a"), (7, "other text here", "fr", "a"),
    (8, "a\nb\na\nb\n\n", "fr", "b"), (9, "éà 日本語 \U0001f600 x\u0000y", "en", "d"), (10, "alpha beta gamma deltb", "en", "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, `_own` INT, `TEXT` STRING, `text_hash` STRING, `a.b` INT, start INT"
    rows = [(i, t, la, s, 1, "x", "y", 2, 3) for i, t, la, s in AWKWARD]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
