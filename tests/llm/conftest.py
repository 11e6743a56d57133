from __future__ import annotations

import os

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("count", T.StringType()), T.StructField("id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("spans", T.StringType()),
    ]
)


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """One shared folder for all that the operators write."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) pairs as a documents table with extra columns of clashing names."""

    def make(pairs):
        rows = [(i, t, "en", "site", len(t) if t is not None else None, "x", 1, 2, None) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows, one id with two texts, odd characters, a very long text."""
    long_ = " ".join(f"w{i * 7919 % 1013}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, "  \t\n "), (None, "text without an id"), (None, None), (4, "one"), (5, "the same words again"), (5, "the same words again"),
        (6, "The SAME words again"), (7, "seven"), (7, "another seven"), (8, long_), (9, long_ + " tail"), (10, "x" * 70_000), (11, "a " * 3000),
        (12, "é\x1fü\x85ß 日本語 ½² <|endoftext|> ’s"), (1 << 62, "far"), (-5, "negative"),
    ]


@pytest.fixture(scope="session")
def awkward_docs(documents):
    return documents(awkward())


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
