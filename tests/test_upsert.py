"""O20/O21 and the sync jobs: idempotence and overwrite semantics."""

from __future__ import annotations

import datetime as dt
import json
import os
from decimal import Decimal

import pytest

from vitrine.operators import Period
from vitrine.schemas import SEARCH_PAGE_KEYS, SEARCH_QUERY_KEYS
from vitrine.streaming import flatten_landing, merge_newest, stream_sync, sync_table

WINDOW = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 7))


def _write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def _row(day, query, page, clicks, impressions, device="MOBILE"):
    return {"keys": [day, query, page, "BRA", device], "clicks": clicks, "impressions": impressions,
            "ctr": clicks / impressions if impressions else 0.0, "position": 3.14159}


def _table(spark, path):
    df = spark.read.parquet(path)
    return sorted((str(r.day), r.query, r.page, r.device, r.clicks, r.impressions, r.ctr, r.position)
                  for r in df.collect())


def test_sync_twice_equals_once_and_overwrites(spark, tmp_dir):
    table = f"{tmp_dir}/search_queries"
    first = [_row("2024-01-01", "a", "/p/1", 1, 10), _row("2024-01-02", "b", None, 2, 20),
             _row("2024-01-03", "c", "/p/2", 0, 0)]
    _write(f"{tmp_dir}/l1/part.json", first)
    sync_table(spark, f"{tmp_dir}/l1", table, "search_queries", WINDOW, dt.datetime(2024, 1, 8))
    once = _table(spark, table)
    sync_table(spark, f"{tmp_dir}/l1", table, "search_queries", WINDOW, dt.datetime(2024, 1, 8))
    assert _table(spark, table) == once
    assert len(once) == 3
    assert once[0][6] == Decimal("0.1000") and once[0][7] == Decimal("3.14")

    # second pull: corrects day 2 (NULL page matches NULL page), adds a key, skips day 1
    second = [_row("2024-01-02", "b", None, 5, 20), _row("2024-01-02", "z", "/p/9", 1, 4),
              _row("2024-01-02", "z", "/p/9", 1, 4)]            # duplicate key inside the batch
    _write(f"{tmp_dir}/l2/part.json", second)
    sync_table(spark, f"{tmp_dir}/l2", table, "search_queries", WINDOW, dt.datetime(2024, 1, 9))
    after = _table(spark, table)
    assert len(after) == 4
    assert ("2024-01-01", "a", "/p/1", "MOBILE", 1, 10, Decimal("0.1000"), Decimal("3.14")) in after
    assert ("2024-01-02", "b", None, "MOBILE", 5, 20, Decimal("0.2500"), Decimal("3.14")) in after
    assert sum(1 for r in after if r[1] == "z") == 1


def test_rows_outside_window_are_ignored_and_empty_batch(spark, tmp_dir):
    table = f"{tmp_dir}/search_pages"
    rows = [{"keys": ["2024-01-05", "/p/1"], "clicks": 3, "impressions": 30, "ctr": 0.1, "position": 2.0},
            {"keys": ["2024-02-05", "/p/1"], "clicks": 3, "impressions": 30, "ctr": 0.1, "position": 2.0}]
    _write(f"{tmp_dir}/lp/part.json", rows)
    sync_table(spark, f"{tmp_dir}/lp", table, "search_pages", WINDOW, dt.datetime(2024, 1, 8))
    assert spark.read.parquet(table).count() == 1
    _write(f"{tmp_dir}/empty/part.json", [])
    sync_table(spark, f"{tmp_dir}/empty", table, "search_pages", WINDOW, dt.datetime(2024, 1, 9))
    assert spark.read.parquet(table).count() == 1


def test_merge_newest_later_batch_wins(spark):
    land = spark.createDataFrame(
        [(["2024-01-01", "/p/1"], 1.0, 10.0, 0.1, 1.005)],
        "keys array<string>, clicks double, impressions double, ctr double, position double")
    land2 = spark.createDataFrame(
        [(["2024-01-01", "/p/1"], 2.0, 10.0, 0.2, 1.0)],
        "keys array<string>, clicks double, impressions double, ctr double, position double")
    b1 = flatten_landing(land, SEARCH_PAGE_KEYS, dt.datetime(2024, 1, 2))
    b2 = flatten_landing(land2, SEARCH_PAGE_KEYS, dt.datetime(2024, 1, 3))
    rows = merge_newest(None, [b1, b2], SEARCH_PAGE_KEYS).collect()
    assert len(rows) == 1 and rows[0].clicks == 2
    assert b1.first().position == Decimal("1.01")


def test_stream_sync_drains_landing_folder(spark, tmp_dir):
    table = f"{tmp_dir}/sq"
    _write(f"{tmp_dir}/stream/a.json", [_row("2024-01-04", "q", "/p/3", 4, 40)])
    q = stream_sync(spark, f"{tmp_dir}/stream", table, "search_queries", WINDOW, f"{tmp_dir}/ckpt")
    q.awaitTermination(120)
    assert [r[4] for r in _table(spark, table)] == [4]
    assert SEARCH_QUERY_KEYS[0] == "day"


def test_sync_search_window_and_ensure(spark, tmp_dir):
    from vitrine.streaming import ensure_table, sync_search
    ensure_table(spark, f"{tmp_dir}/t/search_pages", "search_pages")
    ensure_table(spark, f"{tmp_dir}/t/search_pages", "search_pages")      # idempotent
    from vitrine.schemas import TABLES
    assert spark.read.schema(TABLES["search_pages"]).parquet(f"{tmp_dir}/t/search_pages").count() == 0
    _write(f"{tmp_dir}/lq/a.json", [_row("2024-01-30", "q", "/p/1", 1, 10),
                                    _row("2024-01-20", "old", "/p/1", 1, 10)])
    _write(f"{tmp_dir}/lp/a.json", [{"keys": ["2024-01-29", "/p/1"], "clicks": 1, "impressions": 5,
                                     "ctr": 0.2, "position": 1.5}])
    out = sync_search(spark, f"{tmp_dir}/lq", f"{tmp_dir}/lp", f"{tmp_dir}/t", dt.date(2024, 1, 31))
    assert out == {"period": "2024-01-24 -> 2024-01-30", "search_queries": 1, "search_pages": 1}


def test_stream_sync_without_window_uses_each_batch_span(spark, tmp_dir):
    table = f"{tmp_dir}/sq2"
    _write(f"{tmp_dir}/s2/a.json", [_row("2024-03-04", "q", "/p/3", 4, 40),
                                   _row("2024-03-09", "r", "/p/3", 1, 10)])
    q = stream_sync(spark, f"{tmp_dir}/s2", table, "search_queries", None, f"{tmp_dir}/ck2")
    q.awaitTermination(120)
    assert sorted((r[0], r[1]) for r in _table(spark, table)) == [("2024-03-04", "q"), ("2024-03-09", "r")]
    # a second run over the same folder reads nothing new (the stream checkpoint)
    q = stream_sync(spark, f"{tmp_dir}/s2", table, "search_queries", None, f"{tmp_dir}/ck2")
    q.awaitTermination(120)
    assert len(_table(spark, table)) == 2


def test_later_file_wins_even_with_lower_counts(spark, tmp_dir):
    table = f"{tmp_dir}/sq3"
    _write(f"{tmp_dir}/l/b.json", [_row("2024-01-01", "a", "/p/1", 9, 10)])
    _write(f"{tmp_dir}/l/a.json", [_row("2024-01-01", "a", "/p/1", 4, 10)])
    os.utime(f"{tmp_dir}/l/b.json", (1_700_000_000, 1_700_000_000))
    os.utime(f"{tmp_dir}/l/a.json", (1_700_000_900, 1_700_000_900))
    assert sync_table(spark, f"{tmp_dir}/l", table, "search_queries", WINDOW, dt.datetime(2024, 1, 8)) == 2
    assert [r[4] for r in _table(spark, table)] == [4]


def test_broken_landing_rows_fail_the_run(spark, tmp_dir):
    for k, line in enumerate(['{"keys": ["2024-01-01", "q"', '{"keys": ["no day", "q", "/p", "BRA", "MOBILE"]}', '{"keys": ["2024-01-01"]}', '{}']):
        os.makedirs(f"{tmp_dir}/bad{k}")
        with open(f"{tmp_dir}/bad{k}/x.json", "w") as f:
            f.write(line + "\n")
        with pytest.raises(Exception):
            sync_table(spark, f"{tmp_dir}/bad{k}", f"{tmp_dir}/t{k}", "search_queries", WINDOW)


def test_only_days_of_the_batch_are_rewritten(spark, tmp_dir):
    table = f"{tmp_dir}/sq4"
    _write(f"{tmp_dir}/d1/a.json", [_row(f"2024-01-0{d}", "a", "/p/1", d, 10) for d in range(1, 8)])
    sync_table(spark, f"{tmp_dir}/d1", table, "search_queries", WINDOW)
    before = {d: os.listdir(f"{table}/day=2024-01-0{d}") for d in range(1, 8)}
    _write(f"{tmp_dir}/d2/a.json", [_row(f"2024-01-0{d}", "b", "/p/1", d, 10) for d in (1, 7)])
    sync_table(spark, f"{tmp_dir}/d2", table, "search_queries", WINDOW)
    after = {d: os.listdir(f"{table}/day=2024-01-0{d}") for d in range(1, 8)}
    assert [d for d in before if before[d] != after[d]] == [1, 7] and len(_table(spark, table)) == 9
