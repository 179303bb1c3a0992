"""Awkward rows that every operator has to take."""

import pytest

AWKWARD = [
    (1, "Plain words, some of them twice: some of them."), (2, None), (3, ""), (4, "   \n\t \n"), (5, "Plain words, some of them twice: some of them."), (6, "x" * 5000), (7, "é ß 中文 \U0001f600 ¿qué?\n" * 30), (None, "no id at all"), (1, "Plain words, some of them twice: some of them."),
    (8, "ab " * 3000), (9, "<|endoftext|> is a string"), (10, "́combining ​ zero　wide"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names operators use themselves."""
    rows = [(i, t, "id", [1.0], "n", True) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, items array<double>, words string, gone boolean").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
