import pytest

#: Texts with nulls, blanks, ties, repeats, long runs and odd characters.
EDGE_TEXTS = [
    None, "", " ", "\n\n\t", "a", "The the THE the the the the the", "x" * 5000, "1" * 3000, "1-" * 2000, "a.b" * 1500, "@" * 500,
    "é ü ß 日本 🎉 İ", "<|endoftext|> <|x", "AKIA" * 20, "token=\"abcdefgh\" token = 'short'", "+1 (017) 555-7713 and 4111 1111 1111 1111",
    "mail a.b@c.de, f@g.h.i_j@k.lm", "IP 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8", "GB82 WEST 1234 5698 7654 32", "call 555-123-4567", "line one.\nline one.\nline two!",
    "under the MIT license and Apache License, Version 2.0 or CC BY-NC", "  two  spaces   here ",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "clash", None) for i, t in enumerate(EDGE_TEXTS)] + [(1, "", "clash", None), (None, "no id", "clash", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n long, kept string".replace("n long", "n string"))


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
