import random

import pytest

WORDS = "the of and tree river stone light under over green table house cloud seven north".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns with clashing names."""
    long = prose(60_000, 1)
    rows = [
        (1, "", "en", "a", 1), (2, None, "en", "a", 2), (3, "  \n\t ", None, None, 3), (4, prose(80, 4), "en", "b", 4),
        (4, prose(80, 4), "en", "b", 4), (None, prose(90, 5), "de", None, 5), (None, None, None, None, None),
        (7, long, "en", "b", 7), (8, "x" * 20_000, "en", "a", 8), (9, "<|endoftext|> a  b c d ́e 'll", "fr", "a", 9),
        (10, prose(80, 4), "de", "c", 10), (11, "a", "en", "c", 11), (12, "\U0001F600 漢字 café", "fr", "c", 12),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    more = ("n_words", "kept", "size", "shard", "slot", "block", "node", "component_id", "language", "__text", "bands", "h")
    docs = spark.createDataFrame(rows, schema)
    for name in more:
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
