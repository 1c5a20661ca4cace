"""Landed pages, broken landing rows, key checks in the write."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from vitrine.schemas import LANDING, SEARCH_PAGE_KEYS, SEARCH_QUERY_KEYS, TABLES
from vitrine.sources.pages import IncompletePull, land_pages, read_pages
from vitrine.streaming import ensure_table, sync_search, sync_table, upsert_window
from vitrine.streaming.upsert import QUARANTINE, KeyViolation
from vitrine.operators import Period

WEEK = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 31))


def row(n):
    return {"keys": ["2024-01-05", f"/p/{n}"], "clicks": float(n), "impressions": 10.0, "ctr": n / 10, "position": 1.5}


def land(folder, pages):
    os.makedirs(folder, exist_ok=True)
    for k, (start, n) in enumerate(pages):
        with open(f"{folder}/page-{k}.json", "w") as f:
            json.dump({"startRow": start, "rows": [row(start + i) for i in range(n)]}, f, indent=1)


@pytest.mark.parametrize("pages,rows", [([(0, 3)], 3), ([(0, 4), (4, 4), (8, 1)], 9), ([(8, 1), (0, 4), (4, 4)], 9), ([(0, 4), (4, 0)], 4), ([(0, 0)], 0)])
def test_whole_pulls(spark, tmp_dir, pages, rows):
    land(tmp_dir, pages)
    got = read_pages(spark, tmp_dir, row_limit=4).collect()
    assert sorted(r["keys"][1] for r in got) == sorted(f"/p/{i}" for i in range(rows))
    assert all(r["pulled_from"].endswith(".json") and r["pulled_at"] for r in got)


@pytest.mark.parametrize("pages,message", [
    ([(0, 4), (8, 1)], "1 pages are missing"), ([(4, 2)], "1 pages are missing"), ([(0, 4), (4, 4)], "row 8 was due"),
    ([(0, 3), (4, 1)], "short"), ([(0, 4), (0, 4), (4, 1)], "twice"), ([(0, 5)], "valid start row or size"),
    ([(0, 4), (3, 1)], "valid start row or size")])
def test_a_missing_page_raises(spark, tmp_dir, pages, message):
    land(tmp_dir, pages)
    with pytest.raises(IncompletePull, match=message):
        read_pages(spark, tmp_dir, row_limit=4)


def test_no_page_and_a_broken_page(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/none")
    with pytest.raises(IncompletePull, match="no page"):
        read_pages(spark, f"{tmp_dir}/none")
    land(f"{tmp_dir}/bad", [(0, 2)])
    with open(f"{tmp_dir}/bad/page-1.json", "w") as f:
        f.write('{"startRow": 4, "rows": [')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        read_pages(spark, f"{tmp_dir}/bad", row_limit=4).collect()


@pytest.mark.parametrize("n", [0, 1, 19, 20, 45])
def test_landed_pages_round_trip(spark, tmp_dir, n):
    rows = spark.createDataFrame([tuple(row(i).values()) for i in range(n)], LANDING)
    land_pages(rows, ["keys"], f"{tmp_dir}/pull", row_limit=10)
    got = read_pages(spark, f"{tmp_dir}/pull", row_limit=10).drop("pulled_at", "pulled_from")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


BROKEN = ['{"keys": ["2024-01-05"', '{"keys": ["2024-01-05"], "clicks": 1}', '{"keys": ["05/01", "/p/1"], "clicks": 1}',
          '{"keys": ["2024-01-05", null], "clicks": 1}', '{"keys": ["2024-01-05", "/p/2"], "clicks": "many"}', '{"clicks": 1}']


def test_broken_rows_are_set_aside(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/landing")
    with open(f"{tmp_dir}/landing/a.json", "w") as f:
        f.write("\n".join([json.dumps(row(1)), *BROKEN, json.dumps(row(2))]))
    for _ in range(2):                      # a second run sets nothing aside twice
        assert sync_table(spark, f"{tmp_dir}/landing", f"{tmp_dir}/t", "search_pages", WEEK, None, f"{tmp_dir}/bad") == (2, len(BROKEN))
    stored = spark.read.schema(TABLES["search_pages"]).parquet(f"{tmp_dir}/t").collect()
    assert sorted(r["page"] for r in stored) == ["/p/1", "/p/2"]
    bad = spark.read.schema(QUARANTINE).parquet(f"{tmp_dir}/bad").collect()
    assert len(bad) == len(BROKEN) and {r["reason"] for r in bad} == {"not JSON of the landing layout", "no valid key list"}
    assert all(r["file"].endswith("a.json") and r["pulled_at"] for r in bad)
    assert BROKEN[0] in {r["line"] for r in bad}
    with pytest.raises(Exception):          # without a quarantine one broken line fails the run
        sync_table(spark, f"{tmp_dir}/landing", f"{tmp_dir}/t", "search_pages", WEEK)


def test_a_folder_of_broken_rows_alone(spark, tmp_dir):
    for table in ("search_queries", "search_pages"):
        os.makedirs(f"{tmp_dir}/{table}")
        with open(f"{tmp_dir}/{table}/a.json", "w") as f:
            f.write("\n".join(BROKEN[:2]))
    out = sync_search(spark, f"{tmp_dir}/search_queries", f"{tmp_dir}/search_pages", f"{tmp_dir}/t", dt.date(2024, 1, 8), quarantine_root=f"{tmp_dir}/bad")
    assert out == {"period": "2024-01-01 -> 2024-01-07", "search_queries": 0, "search_queries_broken": 2, "search_pages": 0, "search_pages_broken": 2}


def typed(spark, rows, table="search_queries"):
    return spark.createDataFrame([(dt.date(2024, 1, 5), *r, dt.datetime(2024, 1, 6)) for r in rows], TABLES[table])


def test_a_row_without_its_key_changes_nothing(spark, tmp_dir):
    from decimal import Decimal
    path, measures = f"{tmp_dir}/search_queries", (1, 10, Decimal("0.1"), Decimal("1.5"))
    ensure_table(spark, path, "search_queries")
    ensure_table(spark, path, "search_queries")
    good = typed(spark, [("a", None, "BRA", "X", *measures), ("b", "/p", "BRA", "X", *measures)])
    assert upsert_window(spark, good, path, "search_queries", SEARCH_QUERY_KEYS, None) == 2
    before = sorted(os.listdir(path)), sorted(map(str, spark.read.parquet(path).collect()))
    bad = good.withColumn("query", F.when(F.col("query") == "b", F.col("query"))).withColumn("clicks", F.lit(99))
    with pytest.raises(KeyViolation, match="query"):
        upsert_window(spark, bad, path, "search_queries", SEARCH_QUERY_KEYS, None)
    assert (sorted(os.listdir(path)), sorted(map(str, spark.read.parquet(path).collect()))) == before
    # a NULL page is a key value of its own
    assert upsert_window(spark, good.withColumn("clicks", F.lit(7)), path, "search_queries", SEARCH_QUERY_KEYS, None) == 2
    assert [r["clicks"] for r in spark.read.parquet(path).collect()] == [7, 7]
    assert SEARCH_PAGE_KEYS == ("day", "page")


def test_nothing_is_left_in_the_scratch_folder(spark, tmp_dir):
    from vitrine.session import scratch_dir
    base = scratch_dir(spark, "x").removeprefix("file:").rsplit("/", 1)[0]
    os.makedirs(base, exist_ok=True)
    before = set(os.listdir(base))
    os.makedirs(f"{tmp_dir}/landing")
    with open(f"{tmp_dir}/landing/a.json", "w") as f:
        f.write("\n".join([json.dumps(row(1)), BROKEN[0]]))
    sync_table(spark, f"{tmp_dir}/landing", f"{tmp_dir}/t", "search_pages", WEEK, None, f"{tmp_dir}/bad")
    assert set(os.listdir(base)) == before
