"""Kept summaries: equal to the base tables after every kind of change, read in
their place, and never used when they may be stale."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from vitrine.operators import Period
from vitrine.plans import run
from vitrine.schemas import SEARCH_QUERY_KEYS, curated_schema
from vitrine.sources import from_frames, from_parquet, kept
from vitrine.sources import from_testdata as views
from vitrine.sources.curated import write_curated
from vitrine.streaming import upsert_window

READERS = {
    "q02_revenue_daily": {"sales_days"}, "q05_monthly_compare": {"sales_days"}, "q10_sales_monthly": {"sales_days"},
    "q30_finance_daily": {"sales_days"}, "q12_customer_kpis": {"customers", "customer_state", "sales"},
    "o12_dormant_null_aware": {"customer_state"}, "o12_dormant_no_recent_null": {"customer_state"},
    "q23_dead_stock": {"products", "sku_state"}, "q27_open_shipments": {"shipments"},
    "q34_search_kpis": {"search_days", "search_day_keys"}, "q35_search_clicks_daily": {"search_days"},
    "q39_search_position_daily": {"search_days"}, "q40_search_monthly": {"search_days", "search_day_keys"}}


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def same_answers(spark, root, names=READERS):
    """Every reader answers alike with and without the summaries."""
    with_, without = from_parquet(spark, root), from_parquet(spark, root, summaries=False)
    assert set(kept.SUMMARIES) <= set(with_) and not set(kept.SUMMARIES) & set(without)
    for name in names:
        assert run(name, with_).columns == run(name, without).columns
        assert run(name, with_).dtypes == run(name, without).dtypes
        assert rows(run(name, with_)) == rows(run(name, without)), name


def from_testdata(spark, sf):
    """The test views; of the sales those of a year, so few folders are written."""
    raw = views(spark, sf)
    some = raw["sales"].where("synced_at_text >= '2000-08'")
    lines = raw["sale_items"].join(some.select("sale_id"), "sale_id", "left_semi")
    return from_frames({**{n: raw[n] for n in raw}, "sales": some, "sale_items": lines})


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("kept"))
    write_curated(from_testdata(spark, SF_SMALL), path, files_per_table=2)
    return path


@pytest.mark.parametrize("name", sorted(READERS))
def test_summary_is_read_in_place_of_the_base_table(spark, root, name):
    raw = from_testdata(spark, SF_SMALL)
    df = run(name, from_parquet(spark, root))
    assert rows(df) == rows(run(name, raw))
    plan = df._jdf.queryExecution().executedPlan().toString()
    for table in ("sale_items", "search_queries"):
        assert f"/{table}]" not in plan and f"/{table}/" not in plan, plan
    if "sales" not in READERS[name]:
        assert "/sales]" not in plan and "/sales/" not in plan, plan
    assert "Expand" not in plan                                     # distinct counts come from bitmaps
    if name == "q12_customer_kpis":                                 # of the sales only the period's months
        assert "PartitionFilters: [isnotnull(sale_month" in plan


def test_summaries_follow_a_refresh(spark, root):
    raw = from_testdata(spark, SF_SMALL)
    k = F.col("sale_id")
    day = F.when(k % 9 == 2, F.add_months("sale_date", 14)).when(k % 9 == 4, F.lit(None)).otherwise(F.col("sale_date"))
    changed = raw["sales"].where(k % 9 != 1).withColumn("sale_date", day) \
        .withColumn("status", F.when(k % 9 == 5, F.lit("Cancelado")).otherwise(F.col("status"))) \
        .withColumn("customer_id", F.when(k % 9 == 6, F.lit(10 ** 9) + k).otherwise(F.col("customer_id")))
    queries = raw["search_queries"].where("query <> 'term 8'").withColumn("query", F.when(
        F.col("day") > "2024-01-12", F.concat(F.lit("new "), "query")).otherwise(F.col("query")))
    source = from_frames({**{n: raw[n] for n in raw if n not in ("sales", "search_queries")}, "sales": changed, "search_queries": queries})
    window = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    before = from_parquet(spark, root)["search_keys"].count()
    write_curated(source, root, files_per_table=2, refresh=window)
    assert from_parquet(spark, root)["search_keys"].count() > before        # numbers are added, none changes
    ids = from_parquet(spark, root)["search_keys"].agg(F.count("*"), F.count_distinct("id"), F.max("id")).first()
    assert ids[0] == ids[1] == ids[2]
    same_answers(spark, root)
    raw_again = from_frames({n: source[n] for n in source})
    for name in ("q02_revenue_daily", "q12_customer_kpis", "q23_dead_stock", "q34_search_kpis", "q27_open_shipments"):
        assert rows(run(name, from_parquet(spark, root))) == rows(run(name, raw_again)), name
    write_curated(raw, root, files_per_table=2, refresh=window)             # and back: maxima are taken back
    same_answers(spark, root)
    for name in ("q12_customer_kpis", "q23_dead_stock", "q34_search_kpis"):
        assert rows(run(name, from_parquet(spark, root))) == rows(run(name, raw)), name


def test_refresh_opens_only_the_months_that_differ(spark, tmp_path):
    import os
    raw = from_testdata(spark, SF_SMALL)
    root = str(tmp_path / "cur")
    pair = {n: raw[n] for n in ("sales", "sale_items")}
    write_curated(from_frames(pair), root, names=list(pair), files_per_table=2)
    calm = Period(dt.date(1990, 1, 1), dt.date(1990, 1, 1))                 # a month without rows
    files = lambda: {(d, f) for n in pair for d, _, fs in os.walk(f"{root}/{n}") for f in fs if f.endswith("parquet")}
    first = files()
    write_curated(from_frames(pair), root, names=list(pair), files_per_table=2, refresh=calm)
    assert files() == first                                                 # nothing differs, nothing is opened
    one = raw["sales"].where("sale_date BETWEEN '2000-10-01' AND '2000-10-31'").agg(F.min("sale_id")).first()[0]
    moved = {**pair, "sales": raw["sales"].withColumn("total", F.when(F.col("sale_id") == one, F.lit(1).cast("decimal(18,2)")).otherwise(F.col("total")))}
    write_curated(from_frames(moved), root, names=list(pair), files_per_table=2, refresh=calm)
    assert {d for d, _ in files() ^ first} == {f"{root}/sales/sale_month=2000-10-01", f"{root}/sale_items/sale_month=2000-10-01"}
    lines = {**pair, "sale_items": raw["sale_items"].where(F.col("sale_id") != one)}
    write_curated(from_frames({"sale_items": lines["sale_items"], "sales": raw["sales"]}), root, names=["sale_items"], files_per_table=2, refresh=calm)
    back = spark.read.schema(curated_schema("sales")).parquet(f"{root}/sales")      # lines take their sales along
    assert back.where(F.col("sale_id") == one).first()["total"] != 1
    assert spark.read.parquet(f"{root}/sale_items").where(F.col("sale_id") == one).count() == 0


def test_summaries_follow_an_upsert(spark, tmp_path):
    raw = from_testdata(spark, SF_SMALL)
    root = str(tmp_path / "cur")
    write_curated(raw, root, names=["search_queries", "search_pages"], files_per_table=2)
    more = raw["search_queries"].where("day >= '2024-01-10'").select(
        F.date_add("day", 3).alias("day"), F.concat("query", F.lit(" x")).alias("query"), "page", "country", "device", "clicks", "impressions",
        F.lit(0).cast("decimal(6,4)").alias("ctr"), "position", F.localtimestamp().alias("synced_at"))
    upsert_window(spark, more, f"{root}/search_queries", "search_queries", SEARCH_QUERY_KEYS, None)
    with_, without = from_parquet(spark, root), from_parquet(spark, root, summaries=False)
    assert "search_days" in with_
    for name in ("q34_search_kpis", "q35_search_clicks_daily", "q39_search_position_daily", "q40_search_monthly"):
        assert rows(run(name, with_)) == rows(run(name, without)), name


def test_a_broken_run_leaves_no_summary_in_use(spark, root, monkeypatch):
    raw = from_testdata(spark, SF_SMALL)
    pair = from_frames({n: raw[n] for n in ("sales", "sale_items")})
    window = Period(dt.date(2000, 1, 1), dt.date(2000, 1, 31))
    with monkeypatch.context() as m:
        m.setattr(kept, "update", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            write_curated(pair, root, names=["sales", "sale_items"], refresh=window)
    assert not set(kept.GROUPS["sales"]) & set(from_parquet(spark, root))
    write_curated(pair, root, names=["sales", "sale_items"], refresh=window)       # rebuilt whole
    same_answers(spark, root, ["q02_revenue_daily", "q12_customer_kpis", "q23_dead_stock"])


def test_numbers_are_dense_and_distinct(spark):
    df = spark.range(5000).selectExpr("concat('k', id % 5000) k", "id v").repartition(7)
    got = kept.number_rows(df, ["k"], F.lit(100)).collect()
    assert sorted(r["id"] for r in got) == list(range(101, 5101))
    assert [r["k"] for r in sorted(got, key=lambda r: r["id"])] == sorted(r["k"] for r in got)
    assert kept.number_rows(df.limit(0), ["k"], F.lit(0)).count() == 0


def test_most_months_changed_rebuilds_the_states_whole(spark, tmp_path, monkeypatch):
    raw = from_testdata(spark, SF_SMALL)
    root, k = str(tmp_path / "cur"), F.col("sale_id")
    pair = {n: raw[n] for n in ("sales", "sale_items")}
    write_curated(from_frames(pair), root, names=list(pair), files_per_table=2)
    moved = pair["sales"].where(k % 9 != 1).withColumn("sale_date", F.when(k % 9 == 2, F.add_months("sale_date", -14)).otherwise(F.col("sale_date")))
    now = from_frames({**pair, "sales": moved})
    monkeypatch.setattr(kept, "_swap", lambda *a: (_ for _ in ()).throw(AssertionError("rows of the touched keys were moved")))
    write_curated(now, root, names=list(pair), files_per_table=2, refresh=Period(dt.date(1990, 1, 1), dt.date(1990, 1, 1)))
    live = pair["sale_items"].join(moved, "sale_id").where("sale_date IS NOT NULL AND status NOT IN ('Cancelado', 'Cancelada')")
    dated = moved.where("sale_date IS NOT NULL")
    for name, key, of in (("customer_state", "customer_id", dated), ("sku_state", "sku", live)):
        assert rows(kept.read_summary(spark, root, name)) == rows(of.groupBy(key).agg(F.max("sale_date")))
