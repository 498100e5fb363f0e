import pytest

EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "Same text here, said twice over by two documents in all."),
    (6, "Same text here, said twice over by two documents in all."), (7, "é ü ß 日本語 👍🏽 x²½ \x00 a b c"), (8, "word " * 30000),
    (9, "Licensed under the Apache Licence, Version 2.0. All rights reserved. cc by cc by"), (9, "a repeated id"), (None, "a null id"), (None, None),
    (10, "mail a@b.c_d@e.f or 1.2.3.4.5.6.7.8, 4111 1111 1111 1111, +1 (743) 555-3824. 999.1.1.1"), (11, "<|endoftext|> don't 'S we'll <|endoftext|>"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Rows with nulls, blanks, ties, repeats, a long text, and columns whose names clash with ours."""
    rows = [(i, t, "en", ["b", "a", None][k % 3], 0, "x", 1) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, size int").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
