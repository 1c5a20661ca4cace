"""Queries on the curated copies equal the same queries on the raw views,
and their date filters reach the parquet scan."""

from __future__ import annotations

import re

import pytest

from conftest import SF_SMALL
from vitrine.plans import JOBS, QUERIES, run
from vitrine.sources import from_parquet, from_testdata
from vitrine.sources.curated import write_curated


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    raw = from_testdata(spark, SF_SMALL)
    root = str(tmp_path_factory.mktemp("curated"))
    write_curated(raw, root, files_per_table=3)
    return raw, from_parquet(spark, root)


@pytest.fixture(scope="module")
def bare(spark, both):
    """The curated tables without their summaries."""
    _, cur = both
    return from_parquet(spark, cur["sales"].inputFiles()[0].split("/sales/")[0], summaries=False)


def _sorted(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))


LAZY = sorted(set(QUERIES) - JOBS)         # the jobs are held against the oracle alone


@pytest.mark.parametrize("name", LAZY)
def test_curated_equals_raw(both, bare, name):
    raw, cur = both
    a, b, c = run(name, raw), run(name, cur), run(name, bare)
    assert a.columns == b.columns
    assert _sorted(a) == _sorted(b)
    if name[0] == "q":                      # those that may read a summary
        assert _sorted(a) == _sorted(c)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_filter_reaches_scan(bare):
    cur = bare
    plan = _plan(run("q07_sales_kpis", cur))
    assert "PartitionFilters: [isnotnull(sale_month" in plan
    assert "GreaterThanOrEqual(sale_date,2000-01-01)" in plan
    items_plan = _plan(run("q04_top_products_overview", cur))
    assert "Join" not in items_plan            # lines carry their sale's date and status
    assert "PushedFilters: [IsNotNull(sale_date), GreaterThanOrEqual(sale_date" in items_plan
    search_plan = _plan(run("q35_search_clicks_daily", cur))
    assert "PartitionFilters: [isnotnull(day" in search_plan


def test_product_abc_scans_its_lines_once(both):
    """The grand total reads the grouped rows of the ranking."""
    _, cur = both
    df = run("q19_product_abc", cur)
    df.collect()
    plan = _plan(df)
    subquery, ranking = plan.split("+- Window", 1)
    assert "ReusedExchange" in subquery.split("== Initial Plan ==")[0]
    assert "FileScan" not in subquery.split("== Initial Plan ==")[0]
    assert ranking.split("== Initial Plan ==")[0].count("FileScan") == 1


def test_dead_stock_ranks_without_the_history(bare):
    """Products are ranked from a month-pruned scan; the history is read for
    the skus of the top-k alone."""
    cur = bare
    df = run("q23_dead_stock", cur)
    df.collect()
    final = _plan(df).split("+- == Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line]
    lines = [s for s in scans if "sale_items" in s]
    assert len(scans) == 3 and len(lines) == 2, scans
    assert "PartitionFilters: [isnotnull(sale_month" in lines[0]
    whole = final[final.index(lines[1]) - 800:final.index(lines[1])]
    assert "LeftSemi" in whole, final


def test_no_cross_or_nested_loop_joins(both):
    """One-row results (scalar bundles, ABC totals) attach as scalar
    subqueries, so no plan holds a cross join or a nested-loop join."""
    raw, cur = both
    for name in LAZY:
        for t in (raw, cur):
            plan = _plan(run(name, t))
            assert "CartesianProduct" not in plan, name
            assert "BroadcastNestedLoopJoin" not in plan, name


def test_single_partition_windows_are_bounded(both):
    """A window without PARTITION BY moves its whole input to one task; it may
    only run over bounded inputs: the k rows of a top-k, or one row per
    partition of the distributed prefix sum."""
    _, cur = both
    for name in LAZY:
        plan = _plan(run(name, cur))
        if "Window" not in plan:
            continue
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if line.strip().startswith(("+- Window", "Window")) or " Window [" in line:
                if re.search(r"\], \[_pid#\d+\], \[", line):      # PARTITION BY a range partition
                    continue
                below = "\n".join(lines[i:i + 8])
                assert ("TakeOrderedAndProject" in below or "keys=[_pid" in below
                        or "GlobalLimit" in below), (name, below)


def test_refresh_rewrites_only_the_window(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from vitrine.operators import Period
    from vitrine.sources import from_frames
    raw = from_testdata(spark, SF_SMALL)
    root = str(tmp_path / "cur")
    write_curated(raw, root, names=["sales"], files_per_table=2)
    before = spark.read.parquet(f"{root}/sales")
    before_rows = sorted(map(tuple, before.collect()))
    n_before = len(before_rows)
    jan = before.where(F.col("sale_month") == F.lit(dt.date(2000, 1, 1))).count()
    # a refresh whose source lost every January-2000 sale but keeps the rest
    changed = from_frames({"sales": raw["sales"].where(
        ~F.col("sale_date").between(F.lit(dt.date(2000, 1, 1)), F.lit(dt.date(2000, 1, 31)))
        | F.col("sale_date").isNull())})
    write_curated(changed, root, names=["sales"], files_per_table=2,
                  refresh=Period(dt.date(2000, 1, 10), dt.date(2000, 1, 20)))
    after = spark.read.parquet(f"{root}/sales")
    assert jan > 0
    assert after.count() == n_before - jan
    assert after.where(F.col("sale_month") == F.lit(dt.date(2000, 1, 1))).count() == 0
    # refreshing the same window from the full source brings January back, nothing else changes
    write_curated(raw, root, names=["sales"], files_per_table=2,
                  refresh=Period(dt.date(2000, 1, 1), dt.date(2000, 1, 31)))
    again = spark.read.parquet(f"{root}/sales")
    assert again.count() == n_before
    assert sorted(map(tuple, again.collect())) == before_rows


@pytest.mark.parametrize("name,subqueries", [
    ("q01_overview_kpis", 2), ("q12_customer_kpis", 1), ("q29_finance_kpis", 3),
    ("q19_product_abc", 1), ("q22_stock_abc", 1)])
def test_each_one_row_result_is_one_subquery(bare, name, subqueries):
    import re
    cur = bare
    plan = _plan(run(name, cur))
    assert len(set(re.findall(r"Subquery subquery#(\d+)", plan))) == subqueries


def test_aggregates_combine_before_every_shuffle(both):
    """Each hash exchange that feeds an aggregate sits on a partial
    aggregate, so a hot key reaches the shuffle as one row per task."""
    _, cur = both
    for name in LAZY:
        lines = [ln.strip(" :+-") for ln in _plan(run(name, cur)).splitlines()]
        for i, line in enumerate(lines):
            if not line.startswith("Exchange hashpartitioning") or i == 0 or i + 1 >= len(lines):
                continue
            if lines[i - 1].startswith("HashAggregate") or lines[i - 1].startswith("ObjectHashAggregate"):
                child = lines[i + 1]
                assert "Aggregate" in child, (name, line, child)


def test_no_query_runs_python(both):
    _, cur = both
    for name in LAZY:
        plan = _plan(run(name, cur))
        python_nodes = [n for n in ("MapInPandas", "BatchEvalPython", "ArrowEvalPython",
                                    "FlatMapGroupsInPandas") if n in plan]
        assert python_nodes == [], name


def test_catalog_source(spark, both):
    from vitrine.sources import from_catalog
    raw, _ = both
    for name in ("sales", "sale_items"):
        raw[name].createOrReplaceTempView(name)
    got = run("q17_product_kpis", from_catalog(spark)).collect()
    assert got == run("q17_product_kpis", raw).collect()


def test_source_column_names_feed_the_queries(spark, both):
    """A table shaped like the operational database (its own column names)
    runs through the engine once mapped by the JDBC reader's renaming."""
    from vitrine.sources import from_frames
    from vitrine.sources.jdbc import RENAMES, to_engine_columns
    raw, _ = both
    back = {new: old for old, new in RENAMES["sales"].items()}
    source_shaped = raw["sales"].drop("sale_date").select(
        *[raw["sales"][c].alias(back.get(c, c)) for c in raw["sales"].drop("sale_date").columns])
    mapped = from_frames({"sales": to_engine_columns(source_shaped, "sales")})
    assert sorted(map(tuple, run("q08_sales_by_channel", mapped).collect())) == \
        sorted(map(tuple, run("q08_sales_by_channel", raw).collect()))


def _source_shaped(raw, name):
    """The table as the operational database would hand it over: its own
    column names, wide decimals, a column nobody reads, no row ids."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from vitrine.schemas import PARSED_DATES
    from vitrine.sources.jdbc import RENAMES, ROW_IDS
    back = {new: old for old, new in RENAMES[name].items()}
    skip = {ROW_IDS.get(name), PARSED_DATES.get(name, (None,))[0]}
    cols = []
    for field in raw[name].schema.fields:
        if field.name in skip:
            continue
        wide = isinstance(field.dataType, T.DecimalType) or field.name == "stock"
        c = F.col(field.name).cast("decimal(38,18)") if wide else F.col(field.name)
        if field.name == "synced_at_text":
            c = F.to_timestamp_ntz(field.name)
        cols.append(c.alias(back.get(field.name, field.name)))
    return raw[name].select(*cols, F.lit("x").alias("unread column"))


def test_all_source_tables_reach_the_load_step_and_every_query(spark, both, tmp_path):
    from vitrine.schemas import TABLES
    from vitrine.sources import from_frames
    from vitrine.sources.jdbc import to_engine_columns
    raw, _ = both
    source = from_frames({n: to_engine_columns(_source_shaped(raw, n), n) for n in TABLES})
    for n in TABLES:
        types = {f.name: f.dataType for f in TABLES[n].fields}
        assert all(types[f.name] == f.dataType for f in source[n].schema.fields if f.name in types), n
    root = str(tmp_path / "from-source")
    write_curated(source, root, files_per_table=2)
    loaded = from_parquet(spark, root)
    for name in LAZY:
        assert _sorted(run(name, loaded)) == _sorted(run(name, raw)), name


def test_jdbc_reads_are_split_without_bounds():
    from vitrine.schemas import TABLES
    from vitrine.sources.jdbc import from_jdbc, row_hash_predicates
    assert row_hash_predicates("t", 2) == ["abs(hashtext(t::text)::bigint) % 2 = 0", "abs(hashtext(t::text)::bigint) % 2 = 1"]
    seen = {}

    class Reader:
        def jdbc(self, url, table, predicates=None, properties=None):
            seen[table] = len(predicates), properties
            raise LookupError

        def format(self, kind):
            return self

        def options(self, **opts):
            seen[opts["dbtable"]] = int(opts["numPartitions"]), opts
            return self

        def load(self):
            raise LookupError

    session = type("Session", (), {"read": Reader()})()
    tables = from_jdbc(session, "jdbc:postgresql://db/x", {"user": "u"}, {"sales": (1, 9)}, num_partitions=8)
    for name in TABLES:
        with pytest.raises(LookupError):
            tables[name]
    assert len(seen) == len(TABLES) and all(n == 8 for n, _ in seen.values())
    assert seen["tiny_vendas"][1]["partitionColumn"] == "id_tiny"
    assert seen["tiny_produtos"][1] == {"fetchsize": "10000", "user": "u"}


def test_jdbc_parts_are_disjoint_and_complete():
    """Each row lies in exactly one part; keys decide, so an update moves none."""
    import duckdb
    from vitrine.sources.jdbc import key_hash_predicates, page_predicates
    con = duckdb.connect()
    con.execute("CREATE MACRO hashtext(x) AS CASE WHEN x IS NOT NULL THEN CAST(hash(x) % 4294967296 AS BIGINT) - 2147483648 END")
    con.execute("CREATE TABLE t AS SELECT CASE WHEN i % 10 = 0 THEN NULL ELSE i END AS k, i FROM range(1000) r(i)")
    parts = [con.execute(f"SELECT i FROM t WHERE {p}").fetchall() for p in key_hash_predicates("k", 7)]
    assert sorted(i for rows in parts for (i,) in rows) == list(range(1000)) and min(map(len, parts)) > 50
    assert page_predicates(100, 4) == ["ctid < '(25,0)'::tid", "ctid >= '(25,0)'::tid AND ctid < '(50,0)'::tid",
                                       "ctid >= '(50,0)'::tid AND ctid < '(75,0)'::tid", "ctid >= '(75,0)'::tid"]
    assert page_predicates(0, 4) == ["true"] and len(page_predicates(2, 64)) == 2


def test_jdbc_snapshot_and_changes():
    import datetime as dt

    import duckdb
    from vitrine.sources.jdbc import JdbcChanges, from_jdbc, snapshot_options
    assert snapshot_options(None) == {}
    with pytest.raises(ValueError):
        snapshot_options("x'; DROP TABLE t; --")
    seen = []

    class Reader:
        def jdbc(self, url, table, predicates=None, properties=None):
            seen.append((table, predicates, properties))
            raise LookupError

    session = type("Session", (), {"read": Reader()})()
    for read in (lambda: from_jdbc(session, "u", {}, snapshot="00000003-0000001B-1")["sales"],
                 lambda: JdbcChanges(session, "u", {}, 8, "00000003-0000001B-1").keys()):
        with pytest.raises(LookupError):
            read()
        assert "SNAPSHOT '00000003-0000001B-1'" in seen[-1][2]["sessionInitStatement"]
    assert seen[0][1][0] == "abs(hashtext(id_tiny::text)::bigint) % 64 = 0 OR id_tiny IS NULL" and len(seen[1][1]) == 8
    # the SQL that leaves the database
    con = duckdb.connect()
    con.execute("CREATE TABLE tiny_vendas AS SELECT * FROM (VALUES (1, '2024-01-01 10:00:00'), (2, '2024-01-02 10:00:00'), (3, NULL)) v(id_tiny, synced_at)")
    con.execute("CREATE TABLE tiny_vendas_itens AS SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (2, 'c'), (3, 'd'), (9, 'e')) v(id_pedido, codigo_produto)")
    changes, since = JdbcChanges(None, "u", {}), dt.datetime(2024, 1, 2, 9, 0, 0)
    ask = lambda what, t=None: con.execute(f"SELECT * FROM {changes.query(what, t)}").fetchall()
    assert sorted(r[0] for r in ask("sales", since)) == [2, 3] and len(ask("sales")) == 3 and sorted(ask("keys")) == [(1,), (2,), (3,)]
    assert sorted(r[1] for r in ask("sale_items", since)) == ["b", "c", "d"] and len(ask("sale_items")) == 4


def test_bad_date_counts(both):
    from vitrine.sources.curated import bad_date_counts
    raw, _ = both
    rows = {r.table: r for r in bad_date_counts(raw).collect()}
    assert set(rows) == {"sales", "customers", "payables", "subscription_sales", "subscriptions"}
    assert {n for n, r in rows.items() if r.unparseable} == {"sales", "customers"}   # the views' impossible dates
    assert rows["sales"].rows_with_text > 0


def test_jdbc_options_split_reads():
    from vitrine.sources.jdbc import jdbc_options
    opts = jdbc_options("jdbc:postgresql://db/x", "t", {"user": "u"}, "id", (1, 1000), 16)
    assert opts["partitionColumn"] == "id" and opts["numPartitions"] == "16"
    assert opts["lowerBound"] == "1" and opts["upperBound"] == "1000"
    assert "partitionColumn" not in jdbc_options("jdbc:postgresql://db/x", "t", {})


def test_bucketed_catalog_layout(spark, both, bare, tmp_path):
    """Products and lines bucketed by sku: dead stock runs without a shuffle
    below its final top-k, and every query still equals the raw views."""
    from vitrine.sources import from_catalog
    from vitrine.sources.curated import write_catalog
    raw, _ = both
    spark.sql("CREATE DATABASE IF NOT EXISTS vitrine_test")
    write_catalog(raw, "vitrine_test", str(tmp_path / "cat"), buckets=4)
    cat = from_catalog(spark, "vitrine_test")
    _, cur = both
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")    # as for big tables
    try:
        plan = _plan(run("q23_dead_stock", cat))
        lines = plan.splitlines()
        above = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert "SortMergeJoin" in plan
        for i in above:             # only the rows of the top-k move
            assert any("TakeOrderedAndProject" in line for line in lines[i:i + 5]), plan
        assert "Exchange hashpartitioning" in _plan(run("q23_dead_stock", bare))   # unbucketed shuffles
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name in ("q23_dead_stock", "q18_top_products", "q17_product_kpis", "q07_sales_kpis",
                 "q35_search_clicks_daily", "o10_abc_full_curve"):
        assert _sorted(run(name, cat)) == _sorted(run(name, raw)), name


def _counted(spark, df):
    """The rows, and a count of how many were computed."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(pass_on, df.schema), seen


def test_refresh_reads_its_source_once(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from vitrine.operators import Period
    from vitrine.sources import from_frames
    raw, root = from_testdata(spark, SF_SMALL), str(tmp_path / "cur")
    k = F.col("sale_id")
    some = raw["sales"].where("synced_at_text >= '2001-01'").localCheckpoint()
    items = raw["sale_items"].join(some.select("sale_id"), "sale_id", "left_semi").localCheckpoint()
    write_curated(from_frames({"sales": some, "sale_items": items}), root, names=["sales", "sale_items"], files_per_table=2)
    now = some.where(k % 9 != 1).withColumn("status", F.when(k % 9 == 2, F.lit("Cancelado")).otherwise(F.col("status")))
    (sales, sales_seen), (lines, lines_seen) = _counted(spark, now), _counted(spark, items)
    write_curated(from_frames({"sales": sales, "sale_items": lines}), root, names=["sales", "sale_items"], files_per_table=2,
                  refresh=Period(dt.date(1990, 1, 1), dt.date(1990, 1, 1)))
    assert sales_seen.value == now.count() and lines_seen.value == items.count()
    cur = from_parquet(spark, root, summaries=False)
    assert _sorted(cur["sales"].select("sale_id", "sale_date", "status")) == _sorted(now.select("sale_id", "sale_date", "status"))
    want = items.join(now.select("sale_id", "sale_date", F.col("status").alias("sale_status")), "sale_id", "left")
    cols = ["sale_id", "sku", "line_total", "sale_date", "sale_status"]
    assert _sorted(cur["sale_items"].select(cols)) == _sorted(want.select(cols))
