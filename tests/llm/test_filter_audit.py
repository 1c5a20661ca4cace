"""Filter audit against a plain run of every order, document by document."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from vitrine.llm import filter_audit
from vitrine.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int, mask int, part string"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails(rows):
    """Set of failed filters of (doc_id, text, lang) rows."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        out.append({f for f, x in tests.items() if x})
    return out


def plain_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    out = {}
    failed = fails(rows)
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, f) for (i, _, lang), f in zip(rows, failed, strict=True) if (lang or "") == part]
        share = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in x for _, x in mine) - len(gone), sum(x == {f} for _, x in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for order, step in ((o, s) for p, o, s in out if p == part):
            out[part, order, step].append(share[order[step - 1]])
    return out


def check(got, rows, labels):
    want = plain_audit(rows, labels)
    assert len(got) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): [*(r[c] for c in COLUMNS), r["shapley"]] for r in got} == want


def test_audit_equals_plain_run(spark, table):
    docs, labels = table("sf0.001", "documents"), table("sf0.001", "labels")
    got = QUERIES["op11_filter_audit"](spark, "/root/testdata/sf0.001").collect()
    check(got, list(docs[["doc_id", "text", "lang"]].itertuples(index=False, name=None)),
          [(r.doc_id, r.quality, r.toxic) for r in labels.itertuples()])


def test_audit_edge_rows(spark, repeated_docs, empty_docs):
    # labels: a null id, no label, two label rows of an id, columns named like those used inside
    labels = [(None, 1, 1), (1, 1, None), (1, 0, 1), (3, None, 1), (4, 0, 0), (999, 1, 1), (7, 1, 0)]
    frame = spark.createDataFrame([(*r, 9, "x") for r in labels], LABELS)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in repeated_docs.collect()]
    known = [r for r in labels if r[0] is not None]
    check(filter_audit.audit(filter_audit.masks(repeated_docs, frame)).collect(), rows, known)
    assert filter_audit.audit(filter_audit.masks(empty_docs, frame)).count() == 0
    check(filter_audit.audit(filter_audit.masks(repeated_docs, frame.limit(0))).collect(), rows, [])


def test_audit_oracle_agrees_on_edges(spark, repeated_docs, write_docs):
    labels = spark.createDataFrame([(1, 1, 1, 0, ""), (3, 0, 1, 0, "")], LABELS)
    folder = write_docs(documents=repeated_docs, labels=labels)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    out = con.execute(filter_audit.ORACLE)
    names = [c[0] for c in out.description]
    got = QUERIES["op11_filter_audit"](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(out.fetchall())


def test_fields_do_not_overflow(spark):
    """Counts beyond 32 bits in every class leave neighbouring fields exact."""
    n = 1 << 48
    frame = spark.createDataFrame([("p", m, g, t, n) for m in range(32) for g in (True, False) for t in (True, False)],
                                  "part string, mask int, good boolean, toxic boolean, n long")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(frame).collect()}
    assert len(got) == 600
    for (_, step), r in got.items():
        left = 32 >> step
        assert (r["kept"], r["removed"], r["redundant"]) == (4 * n * left, 4 * n * left, 4 * n * (16 - left))
        assert r["unique_fails"] == 4 * n and r["good_lost"] == r["toxic_lost"] == 2 * n * left
    by_filter = defaultdict(set)
    for (order, step), r in got.items():
        by_filter[order[step - 1]].add(r["shapley"])
    # 24 orders have the filter at each step
    assert all(v == {4 * n * 24 * (16 + 8 + 4 + 2 + 1)} for v in by_filter.values())


@pytest.mark.parametrize("filters", ["A", "AB", "XYZ"])
def test_other_numbers_of_filters(spark, filters):
    frame = spark.createDataFrame([(f"p{m % 3}", m, m % 2 == 0, False, m + 1) for m in range(1 << len(filters))],
                                  "part string, mask int, good boolean, toxic boolean, n long")
    got = filter_audit.audit(frame, filters).collect()
    assert {r["filter_order"] for r in got} == set(map("".join, permutations(filters)))
    for r in got:
        fails_one = [m for m in range(1 << len(filters)) if f"p{m % 3}" == r["part"]
                     and not any(m >> filters.index(f) & 1 for f in r["filter_order"][:r["step"]])]
        assert r["kept"] == sum(m + 1 for m in fails_one)


def test_many_parts(spark):
    """More parts than a task holds at once."""
    frame = spark.range(3000).selectExpr("concat('p', id % 700) part", "cast(id % 32 as int) mask", "id % 5 = 0 good", "false toxic", "id n")
    got = filter_audit.audit(frame).filter("filter_order = 'ABCDE' AND step = 1").collect()
    want = np.zeros(700, dtype=np.int64)
    np.add.at(want, [i % 700 for i in range(3000) if i % 32 & 1 == 0], [i for i in range(3000) if i % 32 & 1 == 0])
    assert {r["part"]: r["kept"] for r in got} == {f"p{k}": int(v) for k, v in enumerate(want)}
