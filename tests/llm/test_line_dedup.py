"""Line dedup against a plain version, and the shape of its plan."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb

from vitrine.llm import line_dedup
from vitrine.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANKS).translate(ASCII)


def plain_lines(texts, least_documents=10, least_chars=1):
    """(lines, dropped, kept text) per text."""
    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for lines in split for k in {key(line) for line in lines} if len(k) >= least_chars)
    out = []
    for lines in split:
        stay = [line for line in lines if seen[key(line)] < least_documents]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def compare(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = line_dedup.cut_lines(df, **options).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, plain_lines([t for _, t in rows], **options), strict=True))
    assert Counter(map(tuple, got)) == want
    return got


def texts():
    """Common lines in many spellings, repeated inside documents, at every place."""
    r = random.Random(5)
    common = ["License line", "é Ü shared", "x", "all rights"]
    blanks = ["", " ", "\t", "\r", "\x0b\x0c", " ", "\x1c"]
    out = []
    for i in range(120):
        lines = []
        for _ in range(r.randrange(0, 9)):
            line = r.choice([*common, *common, f"own {i} {r.random()}", "", " ", f"rare {r.randrange(40)}"])
            line = r.choice([line, line.upper(), line.translate(ASCII)])
            lines.append(r.choice(blanks) + line + r.choice(blanks))
        out.append("\n".join(lines))
    return out


def test_equals_plain_version(spark, repeated_docs, empty_docs):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(5)
    got = compare(df)
    assert 0 < sum(r["n_dropped"] for r in got) < sum(r["n_lines"] for r in got)
    assert any(r["kept"] == "" and r["n_dropped"] == r["n_lines"] for r in got)
    compare(df, least_documents=3, least_chars=2)
    compare(df, least_documents=1, least_chars=0)                       # even empty lines go
    compare(repeated_docs)
    compare(repeated_docs, least_documents=2)
    assert line_dedup.cut_lines(empty_docs).count() == 0


def test_repeated_and_null_ids(spark):
    """Every row is a document, also ten equal rows and rows without an id."""
    rows = [(1, "Same\nown")] * 10 + [(None, "same\nother")] * 3 + [(None, None), (2, ""), (2, "\n"), (3, "own"), (1, "third")]
    compare(spark.createDataFrame(rows, "doc_id long, text string"))


def test_columns_with_clashing_names(spark):
    rows = [(i, "Line\nx%d" % i, "row", "d1", 5, ["q"]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, d1 string, h1 int, lines array<string>")
    out = line_dedup.drop_lines(df)
    assert out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect())) == [(i, f"x{i}", "row", "d1", 5, ["q"]) for i in range(12)]
    odd = df.withColumnRenamed("row", "a.b`c").withColumnRenamed("d1", "dropped")
    assert line_dedup.drop_lines(odd).columns == odd.columns


def test_hot_line_and_long_document(spark):
    """A third of the documents share a line; one document has 30,000 lines."""
    many = "\n".join(f"n{i}" if i % 3 else "HOT " for i in range(30_000))
    rows = [(i, f"a{i}\nhot\nb{i}" if i % 3 == 0 else f"c{i}\nd") for i in range(3000)] + [(9999, many)]
    got = {r["doc_id"]: r for r in compare(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[9999]["n_dropped"] == 10_000 and got[0]["kept"] == "a0\nb0" and got[1]["kept"] == "c1"


def test_query_on_whole_table(spark, table):
    docs = table("sf0.001", "documents")
    got = QUERIES["op13_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    want = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest())
                   for i, (n, d, t) in zip(docs.doc_id.tolist(), plain_lines(docs.text), strict=True))
    assert Counter(map(tuple, got)) == want


def test_oracle_agrees_on_edges(spark, repeated_docs, write_docs):
    more = spark.createDataFrame([(100 + i, t, None, None, None, None, None, None) for i, t in enumerate(texts())], repeated_docs.schema)
    folder = write_docs(documents=repeated_docs.union(more))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    out = con.execute(line_dedup.ORACLE)
    names = [c[0] for c in out.description]
    got = QUERIES["op13_line_dedup"](spark, folder)
    assert got.columns == names
    assert Counter(map(tuple, got.collect())) == Counter(out.fetchall())


def test_plan_is_native(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    plan = line_dedup.cut_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
