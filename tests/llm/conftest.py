from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("h", T.StringType()),
                     T.StructField("row", T.StringType()), T.StructField("component_id", T.StringType())])


def invented(seed: int, n: int, vocabulary: int = 400) -> str:
    """n words drawn unevenly from a small invented vocabulary."""
    r = random.Random(seed)
    words = ["".join(random.Random(w).choices("abcdeghilmnorstu", k=3 + w % 7)) for w in range(vocabulary)]
    return " ".join(words[min(int(r.expovariate(0.02)), vocabulary - 1)] for _ in range(n))


def document_rows() -> list[tuple]:
    """Plain, null, empty, very long, repeated and copied texts; extra columns
    whose names the operators use inside."""
    a, b, passage = invented(1, 300), invented(2, 40), invented(3, 60)
    texts = [a, b, None, "", "   \t\n", "one", "some words", a, a + " tail", passage + " " + b, b + "\n" + passage,
             invented(4, 20_000), "x" * 500, "ab" * 300, "é à ü " * 80, "\x00 nul \x00 byte", "12 34 !!",
             " Mixed CASE\u00a0nbsp\x1cfs ", passage, "the the the " * 100]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", None if t is None else len(t), "h", "r", "c") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), DOCS)


@pytest.fixture(scope="session")
def repeated_docs(spark):
    """Null and repeated ids, fully equal rows."""
    rows = document_rows()
    odd = [(None, rows[0][1], "en", "s", 1, "h", "r", "c"), (None, None, None, None, None, None, None, None),
           rows[1], rows[1], (1, rows[0][1], "fr", "s", 1, "h", "r", "c")]
    return spark.createDataFrame(rows + odd, DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def table():
    def read(sf: str, name: str):
        return duckdb.sql(f"select * from read_parquet('/root/testdata/{sf}/{name}.parquet')").df()
    return read


@pytest.fixture()
def write_docs(tmp_path):
    """Folder with a documents.parquet (and others) made of given DataFrames."""
    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write
