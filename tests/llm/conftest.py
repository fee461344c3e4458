import os

import pytest

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs001(spark):
    return spark.read.parquet(os.path.join(SF001, "documents.parquet"))


@pytest.fixture(scope="session")
def texts001(docs001):
    return {r.doc_id: r.text or "" for r in docs001.collect()}


LONG = "wort " * 30_000 + "\n" + "x" * 70_000


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties and repeated
    rows, and columns whose names clash with the operators' own."""
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 3),
            (None, "a null id has a text of its own here", "en", None, None), (None, None, None, None, None),
            (4, "one two three four five six seven", "en", "s", 1), (4, "one two three four five six seven", "en", "s", 1),
            (5, "one two three four five six seven", "en", "s", 1), (6, LONG, "de", "s", 9), (7, "word", "en", "s", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    d = spark.createDataFrame(rows, schema)
    clash = ["_t", "_w", "_row", "th", "h", "g", "k", "v", "n", "c", "word", "set", "keys", "label", "_gone_id", "_n_lines"]
    return d.selectExpr("*", *[f"doc_id AS `{x}`" for x in clash])


@pytest.fixture(scope="session")
def plain_edge(edge):
    return edge.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def empty(plain_edge):
    return plain_edge.filter("false")
