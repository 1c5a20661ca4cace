"""Fill-in-middle against a plain version on strings, and its exact round trip."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.llm import fill_middle
from vitrine.llm.queries import QUERIES

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_fim(doc_id, text, unit="word", rate=50, spm_rate=80, seed=42):
    text = text or ""
    units = re.findall(TOKEN, text) if unit == "word" else list(text)
    n = len(units)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["a<P>b", "<S>", "x <M", "<", "<P", "<S", " \x1c\x85 a b ", " lead", "trail \n", "\t\n\x0b\x0c\r ", "é", "😀 😀é a\n\n", "ā" * 999,
       "𝔘 " * 700, "a" * 70_000 + " é" * 10, "<P <S <M", "S><P", "\x00 \x00"]


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def compare(df, **options):
    out = fill_middle.transform(df, **options)
    got = out.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(plain_fim(i, t, **options) for i, t in rows_of(df))
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t in rows_of(df))
    return Counter(r["form"] for r in got)


def test_equals_plain_version(spark, repeated_docs, empty_docs):
    odd = spark.createDataFrame([(100 + 20 * k + i, t) for k in range(20) for i, t in enumerate(ODD)], "doc_id long, text string")
    compare(repeated_docs)
    forms = compare(odd)
    assert len(forms) == 3
    assert compare(odd, unit="char", rate=100, spm_rate=30, seed=7)["psm"] > 100
    assert compare(odd, rate=0).keys() == {"plain"}
    assert fill_middle.transform(empty_docs).count() == 0
    text_ids = spark.createDataFrame([("a", "x y z"), ("b", "é ü"), (None, "q r")], "doc_id string, text string")
    compare(text_ids, rate=100)


def test_query_on_whole_table(spark, table):
    docs = table("sf0.001", "documents")
    want = Counter()
    for i, t in zip(docs.doc_id.tolist(), docs.text, strict=True):
        *head, out = plain_fim(i, t)
        want[*head, sha(out), sha(t or "")] += 1
    got = QUERIES["op12_fill_middle"](spark, "/root/testdata/sf0.001").collect()
    assert Counter(map(tuple, got)) == want


def test_oracle_agrees_on_edges(spark, repeated_docs, write_docs):
    odd = spark.createDataFrame([(100 + i, t, None, None, None, None, None, None) for i, t in enumerate(ODD)], repeated_docs.schema)
    folder = write_docs(documents=repeated_docs.union(odd))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    out = con.execute(fill_middle.ORACLE)
    names = [c[0] for c in out.description]
    got = QUERIES["op12_fill_middle"](spark, folder)
    assert got.columns == names
    assert Counter(map(tuple, got.collect())) == Counter(out.fetchall())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8")), max_size=6))
def test_exception_index_converts_both_ways(texts):
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    index = fill_middle.Exceptions(data)
    whole = "".join(texts)
    chars = np.arange(len(whole) + 1)
    cuts = np.concatenate([[0], np.cumsum([len(c.encode()) for c in whole])]).astype(np.int64)
    assert index.chars(cuts).tolist() == chars.tolist()
    assert index.bytes(chars).tolist() == cuts.tolist()
    assert len(index.byte) == sum(c > "\x7f" for c in whole)          # ASCII leaves no entry


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85 aé😀<P>"), max_size=12), max_size=6))
def test_word_ends_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    offset = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ends = fill_middle.word_ends(np.frombuffer(b"".join(raw), dtype=np.uint8), offset)
    want = [int(offset[k]) + len(t[:m.end()].encode()) for k, t in enumerate(texts) for m in re.finditer(TOKEN, t)]
    assert ends.tolist() == want


def test_same_result_in_any_partitioning(spark):
    rows = [(i, " ".join(random.Random(i).choices(["é", "bc", "😀", "d\n"], k=i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = Counter(map(tuple, fill_middle.transform(df.coalesce(1)).collect()))
    assert one == Counter(map(tuple, fill_middle.transform(df.repartition(7)).collect()))
