"""Small tables with every awkward case the operators define a result for."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Extra columns named like the operators' own.
CLASHES = ("size", "target", "copies", "node", "key", "spans", "root", "score", "sequence_id", "__key", "u", "__h", "__rn", "__id", "__clean", "clean")


def words(n, seed=0):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 100003}" for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    long_text = words(30_000, 5)
    return [
        (1, words(60, 1), "en", "a", 100),
        (2, words(60, 1), "en", "a", 100),
        (2, words(60, 1), "en", "a", 100),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, "  \t\n ", "de", None, 5),
        (None, words(40, 2), "fr", "b", 7),
        (6, long_text, "en", "c", len(long_text)),
        (7, "x" * 50_000, "en", "c", 50_000),
        (8, "one two three", None, "b", 13),
        (9, words(60, 1) + " tail", "es", None, 9),
        (10, "ünï cödé ćĄß 日本語 text   here", "en", "a", 30),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture(scope="session")
def clash_docs(spark, edge_rows):
    schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in CLASHES]])
    return spark.createDataFrame([(*row, *CLASHES) for row in edge_rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)

    return make
