"""URL rules, WARC archives, embeddings and the pipeline."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from vitrine.llm import sphere_caps, url_rules, warc
from vitrine.llm.common import connected_components, shared_path
from vitrine.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, host string, path string, rule string, sha string"


def page(i, url, html="x"):
    return (i, url, html, "h", "p", "r", "s")


# ------------------------------------------------------------------ op10

RULES = url_rules.RULES


def judge(url, rules=RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


URLS = ["http://a.example.com/en/1?x#y", "http://www.example.com/en/", "http://x.WWW.Example.com/en/q", "https://com/",
        "https://com", "http://net/es/1", "http://my.net/es", "http://notexample.com/en/", "http://b.net/fr/é", None, "", "mailto:a",
        "://net/fr/", "http://a.net/es/://b", "http://net?/es/", "http://a.net./es/", "http://\nnet/es/", "x://y.net/fr/" + "d/" * 3000,
        "http://" + "s." * 300 + "net/es/"]


def test_url_rules(spark, table):
    df = spark.createDataFrame([page(i, u) for i, u in enumerate(URLS)] + [page(None, URLS[0]), page(0, URLS[0])], PAGES)
    out = url_rules.filter_urls(df, url_rules.rule_table(spark, RULES)).collect()
    want = [(i, *judge(u)) for i, u in enumerate(URLS)] + [(None, *judge(URLS[0])), (0, *judge(URLS[0]))]
    assert Counter(map(tuple, out)) == Counter(want)
    out = QUERIES["op10_url_filters"](spark, "/root/testdata/sf0.001").collect()
    pages = table("sf0.001", "pages")
    assert Counter(map(tuple, out)) == Counter((i, *judge(u)) for i, u in zip(pages.page_id, pages.url, strict=True))
    assert url_rules.filter_urls(df.limit(0), url_rules.rule_table(spark, RULES)).count() == 0
    assert {r["verdict"] for r in url_rules.filter_urls(df, url_rules.rule_table(spark, RULES).limit(0)).collect()} == {"allow"}


def test_url_rules_any_path(spark):
    rules = [("block", "a.b", "/x"), ("allow", "a.b", "/x/y"), ("block", "b", "/x/yz/"), ("allow", "b", ""), ("block", "c", ""),
             ("allow", "c", "")]
    urls = [f"http://{h}{p}" for h in ("a.b", "q.a.b", "b", "c") for p in ("", "/", "/x", "/x/yz/1", "/xy", "/x/y")]
    out = url_rules.filter_urls(spark.createDataFrame([page(i, u) for i, u in enumerate(urls)], PAGES),
                                url_rules.rule_table(spark, rules)).collect()
    assert sorted(map(tuple, out)) == [(i, *judge(u, rules)) for i, u in enumerate(urls)]


def test_url_oracle_agrees(spark):
    duckdb.sql("create or replace view pages as select * from read_parquet('/root/testdata/sf0.01/pages.parquet')")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = duckdb.sql(url_rules.ORACLE).df()[cols].astype(object)
    out = QUERIES["op10_url_filters"](spark, "/root/testdata/sf0.01").collect()
    none = lambda v: None if v is None or v != v else v
    assert Counter(map(tuple, out)) == Counter(tuple(map(none, r)) for r in want.itertuples(index=False, name=None))


# ------------------------------------------------------------------ op5

def expected(rows):
    top = defaultdict(lambda: None)
    data = [(i, (h or "").encode()) for i, h in rows]
    for i, p in data:
        if i is not None and (top[p] is None or i > top[p]):
            top[p] = i
    return Counter((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                    *(("response", None) if i == top[p] else ("revisit", top[p]))) for i, p in data)


def test_warc_round_trip(spark, table):
    rows = [page(1, "http://a/ \r\nX: y", "<p>é</p>"), page(2, None, "<p>é</p>"), page(3, "u", None), page(4, "u", ""),
            page(None, "u", "<p>é</p>"), page(None, "u", "alone"), page(5, "u", "z" * 300_000), page(6, "u", "a\r\n\r\nb\r\n\r\n"),
            page(2, "again", "<p>é</p>"), page(7, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, PAGES)
    folder = shared_path(spark, "warc-test")
    index = warc.write_archives(df, folder, roll_bytes=500)
    assert index.select("file").distinct().count() > 1
    back = warc.read_records(index, folder).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in back)
    assert got == expected([(r[0], r[2]) for r in rows])
    texts = {r["page_id"]: r["payload"] for r in back if r["record_type"] == "response"}
    assert texts[6] == b"a\r\n\r\nb\r\n\r\n" and texts[7] == b"z" * 300_000
    some = warc.read_records(index.filter("page_id = 6"), folder).collect()
    assert [r["page_id"] for r in some] == [6]
    pages = table("sf0.001", "pages")
    out = QUERIES["op5_warc"](spark, "/root/testdata/sf0.001")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect())
    assert got == expected(list(zip(pages.page_id.tolist(), pages.html, strict=True)))
    empty = warc.write_archives(df.limit(0), shared_path(spark, "warc-test"))
    assert warc.read_records(empty, folder).count() == 0


def test_warc_least_size(spark):
    df = spark.createDataFrame([page(i, "u", "same" if i < 3 else "longer text") for i in range(6)], PAGES)
    index = warc.write_archives(df, shared_path(spark, "warc-test"), min_bytes=5)
    kinds = {r["page_id"]: r["record_type"] for r in index.collect()}
    assert [kinds[i] for i in range(6)] == ["response"] * 3 + ["revisit"] * 2 + ["response"]


# ------------------------------------------------------------------ op9

def check_vectors(ids, vectors, out, recall=1.0):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v) for v in vectors]
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if k else None for v, k in zip(vectors, ok, strict=True)]
    links, root = [0] * len(ids), list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                ra, rb = a, b
                while root[ra] != ra:
                    ra = root[ra]
                while root[rb] != rb:
                    rb = root[rb]
                root[max(ra, rb)] = min(ra, rb)
    assert len(out) == len(ids)
    found = sum(r["n_links"] for r in out)
    assert recall * sum(links) <= found <= sum(links)
    if found == sum(links):
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        low = defaultdict(lambda: 1 << 62)
        for k, i in enumerate(ids):
            low[find(k)] = min(low[find(k)], i)
        want = Counter((i, links[k], low[find(k)]) for k, i in enumerate(ids))
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_vectors_equal_brute_force(spark, table):
    e = table("sf0.001", "embeddings")
    check_vectors(e.vec_id.tolist(), [list(map(float, v)) for v in e.embedding], QUERIES["op9_sphere_caps"](spark, "/root/testdata/sf0.001").collect())


@pytest.mark.parametrize("tile", [1024, 16])
def test_vectors_edges_and_clusters(spark, tile, write_docs):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        rows += [(centre + 0.08 * rng.standard_normal(16)).tolist() for _ in range(40)]
    rows += [rows[0], rows[0], (2 * np.array(rows[1])).tolist(), None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14,
             [float("inf")] * 16, [1.0] * 8, [1.0] * 8, [1e300] * 16, [1e-300] * 16]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, unit string")
    out = sphere_caps.vector_links(df, tile=tile).withColumn("kept", sphere_caps.F.expr("vec_id = component_id")).collect()
    scaled = [v if v is None or not v or None in v or not np.isfinite(v).all() or not np.any(v) else (np.array(v) / np.abs(v).max()).tolist() for v in rows]
    check_vectors(list(range(len(rows))), scaled, out, recall=0.97)
    assert QUERIES["op9_sphere_caps"](spark, write_docs(embeddings=df.limit(0))).count() == 0


def test_vectors_null_and_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(7, a), (None, a), (7, a), (7, b), (None, c), (None, None), (3, None)]
    out = sphere_caps.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(map(tuple, out)) == Counter([(7, 2, 7), (None, 2, 7), (7, 2, 7), (7, 0, 7), (None, 0, None), (None, 0, None), (3, 0, 3)])


def test_filters_do_not_depend_on_the_batch():
    """A vector alone, among others and in another order gets the same filters."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = sphere_caps.codebook(64, 2, 90, 17)
    row, key = sphere_caps.directions(x, book, 0.3, 8)
    want = [set(key[row == k].tolist()) for k in range(len(x))]
    assert min(map(len, want)) >= 8
    order = rng.permutation(len(x))
    row, key = sphere_caps.directions(x[order], book, 0.3, 8)
    assert [set(key[row == k].tolist()) for k in np.argsort(order)] == want
    assert all(set(sphere_caps.directions(x[k:k + 1], book, 0.3, 8)[1].tolist()) == want[k] for k in range(0, 300, 7))


def test_list_decode_is_complete():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = sphere_caps.codebook(12, 3, 5, 1)
    row, key = sphere_caps.list_decode(x, book, 0.35)
    every = np.array([np.concatenate([book[0][i], book[1][j], book[2][k]]) for i in range(5) for j in range(5) for k in range(5)])
    assert set(zip(row.tolist(), key.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ every.T >= 0.35)), strict=True))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (3, 4), (4, 3)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(200, 260)}, 3: 3, 4: 3}


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, table, write_docs, repeated_docs, empty_docs):
    from tests.llm import test_text_ops as brute

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.count()
    fps = {i: brute.fingerprint(t) for i, t in brute.pairs(docs)}
    ids = sorted(fps)
    comp = brute.components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 3])
    one = stages["simhash_near_dedup"](spark, docs, "")
    assert sorted(r["doc_id"] for r in one.collect()) == [ids[k] for k in range(len(ids)) if comp[k] == k]
    full = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert full and sum(r["length"] for r in full if r["doc_id"] == full[0]["doc_id"]) == full[0]["doc_tokens"]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for odd in (repeated_docs, empty_docs):
        folder = write_docs(documents=odd, benchmark=bench)
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() > 0) == (odd.count() > 0)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, odd, folder).columns == odd.columns, name
