"""Curated copies: the ten tables with their text dates parsed once.

Queries filter on parsed dates. Parsing text inside the filter (operator
O1) hides the predicate from the parquet reader, so every query would scan
every row. A curated copy stores the parsed DATE column, clustered on it
(range-partitioned and sorted, so each file and row group covers a narrow
date range) and, for the big date-filtered tables, partitioned by month or
day. Filters on that column then reach the scan (``PushedFilters`` and
partition pruning in the plan).

The curate job is the engine's load step: it runs once per data refresh
and every dashboard query reads its output.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.period import Period
from ..schemas import PARSED_DATES, TABLES, curated_schema
from ..session import COMPRESSION, path_exists, remove_path, scratch_dir
from . import kept
from .tables import Tables

# table -> (clustering columns, partition column or None). The clustering
# columns end in a (near) unique key, so range partitioning can split a
# date or a query that holds a large share of the rows across tasks.
LAYOUT = {
    "sales": (("sale_date", "sale_id"), "sale_month"),
    "sale_items": (("sale_date", "sale_id", "sku"), "sale_month"),
    "products": (("sku",), None),
    "customers": (("created_date", "customer_id"), None),
    "payables": (("due_on", "period_label", "amount"), None),
    "subscription_sales": (("confirmed_date", "event_id"), None),
    "subscriptions": (("started_date", "event_id"), None),
    "shipments": (("sale_id", "tracking_code"), "delivered"),
    "search_queries": (("query", "page", "device"), "day"),
    "search_pages": (("page",), "day"),
}

# Rows per output file the writer aims at (64-128 MB of parquet at scale).
TARGET_ROWS_PER_FILE = 2_000_000


def curated_frame(tables: Tables, name: str) -> DataFrame:
    """The table with its parsed date (and, for sales, the month it falls in).

    Order lines also carry their sale's date and status: the lines-to-sales
    join (the largest shuffle of the dashboard: every line moves by sale id)
    runs once here instead of in every product query, and the period filter
    then prunes the lines by month folder and row group. ``sale_id`` is the
    sales key, so the left join adds at most one match per line; a line
    whose sale is missing keeps NULLs and drops out of every period filter,
    as the inner join would drop it. Parcels carry their sale's customer, state
    and total in the same way."""
    df = tables[name]
    if name == "sales":
        df = df.withColumn("sale_month", F.trunc("sale_date", "month"))
    elif name == "sale_items":
        sales = tables["sales"].select("sale_id", "sale_date", F.col("status").alias("sale_status"))
        df = (df.select(*[f.name for f in TABLES[name].fields]).join(sales, "sale_id", "left")
                .withColumn("sale_month", F.trunc("sale_date", "month")))
    elif name == "shipments":
        sales = tables["sales"].select("sale_id", F.col("customer_name").alias("sale_customer_name"),
                                       F.col("state").alias("sale_state"), F.col("total").alias("sale_total"))
        df = df.select(*[f.name for f in TABLES[name].fields]).join(sales, "sale_id", "left")
    return df


def _window_values(part: str, lo: dt.date, hi: dt.date) -> list[dt.date]:
    """Partition values of a window: the starts of its months, or its days."""
    if part == "day":
        return [lo + dt.timedelta(days=k) for k in range((hi - lo).days + 1)]
    first, last = 12 * lo.year + lo.month - 1, 12 * hi.year + hi.month - 1
    return [dt.date(m // 12, m % 12 + 1, 1) for m in range(first, last + 1)]


def typed(df: DataFrame, name: str) -> DataFrame:
    """The columns of a curated table; what the source lacks is NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in curated_schema(name).fields])


def month_digests(df: DataFrame) -> dict:
    """Per month (None: undated) an order-free digest of its rows: their
    number and two sums of hashes. One row a month comes to the driver."""
    cols = sorted(c for c in df.columns if c != "sale_month")
    rows = df.groupBy("sale_month").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("x"),
        F.sum(F.shiftright(F.xxhash64(F.lit(1), *cols), 24)).alias("s"))
    return {r["sale_month"]: (r["n"], r["x"], r["s"]) for r in rows.collect()}


_DIGESTS = "sale_month date, n long, x long, s long"


def _digest_path(root: str, name: str) -> str:
    return f"{root}/_digests/{name}"


def _stored_digests(spark, root: str, name: str) -> dict:
    """Digests of the stored table: as kept by its last refresh, else computed."""
    path = _digest_path(root, name)
    if path_exists(spark, path):
        return {r[0]: tuple(r[1:]) for r in spark.read.schema(_DIGESTS).parquet(path).collect()}
    return month_digests(spark.read.schema(curated_schema(name)).parquet(f"{root}/{name}"))


def _keep_digests(spark, root: str, name: str, digests: dict) -> None:
    spark.createDataFrame([(m, *d) for m, d in digests.items()], _DIGESTS).coalesce(1) \
        .write.mode("overwrite").parquet(_digest_path(root, name))


def forget_digests(spark, root: str, name: str) -> None:
    """After a change of the stored rows by other means."""
    remove_path(spark, _digest_path(root, name))


def _write(df: DataFrame, path: str, cluster, part: str | None, n: int | None, dynamic: bool = False) -> None:
    """Each task takes one range of the sort order, rows sorted inside it;
    without ``n`` the rows stay in the tasks that read them."""
    keys = ([part] if part else []) + list(cluster)
    if n is None:
        out = df
    elif part == "sale_month":
        # the order of the dates is that of their months: the month need not move
        out = df.drop(part).repartitionByRange(n, *cluster).withColumn(part, F.trunc("sale_date", "month"))
    else:
        out = df.repartitionByRange(n, *keys)
    writer = out.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", COMPRESSION) \
        .option("maxRecordsPerFile", TARGET_ROWS_PER_FILE)
    if part:
        writer = writer.partitionBy(part)
        if dynamic:
            writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def among(part: str, values) -> Column:
    """Rows of the partitions ``values`` (None among them: those without one)."""
    dated = sorted(v for v in values if v is not None)
    wanted = F.col(part).isin(dated) if dated else F.lit(False)
    return wanted | F.col(part).isNull() if None in values else wanted


def stage(df: DataFrame, path: str) -> None:
    """Keep rows in the checkpoint folder, as they come: what replaces stored
    rows with them puts them in order."""
    df.write.option("compression", COMPRESSION).parquet(path)


def replace_partitions(staged: DataFrame, root: str, name: str, values: set, n: int | None) -> None:
    """Overwrite the partitions ``values`` of a stored table by staged rows, in
    ``n`` ranges (None: staged in order already); a partition left without rows is
    deleted. Running it again changes nothing."""
    spark, (cluster, part) = staged.sparkSession, LAYOUT[name]
    # partition values present: at most those asked for
    present = {r[0] for r in staged.select(part).distinct().collect()}
    if present:
        _write(staged, f"{root}/{name}", cluster, part, n, dynamic=True)
    for value in values - present:
        remove_path(spark, f"{root}/{name}/{part}={'__HIVE_DEFAULT_PARTITION__' if value is None else value.isoformat()}")


def _with_stored(tables: Tables, root: str, spark, needed: set) -> Tables:
    """The source's tables; of those it lacks the stored ones."""
    for n in needed:
        if n not in tables:
            tables = _with_rows(tables, n, f"{root}/{n}", spark)
    return tables


def _with_rows(tables: Tables, name: str, path: str, spark) -> Tables:
    """The tables, one of them read from its curated rows at ``path``."""
    return Tables({**{n: (lambda n=n: tables[n]) for n in tables},
                   name: lambda: spark.read.schema(curated_schema(name)).parquet(path)})


def write_curated(tables: Tables, root: str, names=None, files_per_table: int | None = None,
                  refresh: Period | None = None, summaries: bool = True) -> None:
    """Write each table to ``<root>/<name>`` in the layout above.

    Order lines and parcels carry copies of their sale's columns, so sales are
    never written without their lines (nor lines without their sales in a
    refresh) and the parcels the source has.

    With ``refresh`` (a date window) only some partitions are rewritten. Sales
    and lines: the window's months and every month in which a sale or a line
    was added, changed, moved, cancelled or deleted since the last write,
    wherever it lies, the undated rows included; both tables get the same
    months. Months are compared by a digest of their rows, the source's against
    the stored table's, which the last refresh has kept: the stored history is
    not read, and only months that differ are opened. The source is read once:
    its rows are staged, and digests and new months taken from there. Search
    tables: the window's days. The other tables are rewritten whole. New rows are
    first staged in the checkpoint folder (the target is untouched until they are
    complete), then overwrite their partitions (dynamic partition overwrite); a
    partition left without rows is deleted. Lines and parcels take their sale's
    columns from the sales just staged or written, not from the source again.

    ``summaries``: write the kept summaries (``kept.py``) of sales, lines and
    search queries as well, in a refresh those of the changed partitions."""
    names = list(names or LAYOUT)
    pair = {"sales", "sale_items"}
    if "sales" in names and "sale_items" not in names and (refresh is not None or "sale_items" in tables):
        names.append("sale_items")
    if refresh is not None and "sale_items" in names and "sales" not in names:
        names.append("sales")
    if refresh is not None and "sales" in names and "shipments" in tables and "shipments" not in names:
        names.append("shipments")
    if refresh is None and "sale_items" not in tables:
        names = [n for n in names if n != "sale_items"]
    spark = next(iter(tables[n] for n in tables)).sparkSession
    n = files_per_table or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    needed = set(names) | ({"sales"} if {"sale_items", "shipments"} & set(names) else set())
    source = _with_stored(tables, root, spark, needed)
    names.sort(key=lambda name: name != "sales")            # lines and parcels read the sales
    months: set = set()
    digests: dict = {}
    staged: dict = {}
    values: dict = {}
    if refresh is not None:
        months = set(_window_values("sale_month", refresh.start, refresh.end))
    for name in names:
        part = LAYOUT[name][1]
        if refresh is None or part not in ("sale_month", "day"):
            continue
        staged[name] = scratch_dir(spark, f"curate-{name}-{uuid.uuid4().hex}")
        rows = typed(curated_frame(source, name), name)
        if part == "day":
            values[name] = set(_window_values(part, refresh.start, refresh.end))
            rows = rows.where(among(part, values[name]))
        stage(rows, staged[name])
        if name == "sales":
            source = _with_rows(source, name, staged[name], spark)
        if name in pair:
            values[name] = months
            digests[name] = month_digests(spark.read.schema(curated_schema(name)).parquet(staged[name]))
            old = _stored_digests(spark, root, name)
            months |= {m for m in {*old, *digests[name]} if old.get(m) != digests[name].get(m)}
    in_use = {g: kept.suspend(spark, root, g) for g in kept.GROUPS if g in names}
    for name in names:
        cluster, part = LAYOUT[name]
        if name not in staged:
            _write(curated_frame(source, name), f"{root}/{name}", cluster, part, n)
            forget_digests(spark, root, name)
            if name == "sales":
                source = _with_rows(source, name, f"{root}/{name}", spark)
            continue
        rows = spark.read.schema(curated_schema(name)).parquet(staged[name]).where(among(part, values[name]))
        replace_partitions(rows, root, name, values[name], n)
        if name in digests:
            _keep_digests(spark, root, name, digests[name])
    for path in staged.values():
        remove_path(spark, path)
    for group, was in in_use.items():
        if summaries:
            kept.update(spark, root, group, values[group] if was and group in values else None)


# Tables stored bucketed by sku in the catalog layout (the dead-stock join).
BUCKETED_BY_SKU = ("products", "sale_items")


def write_catalog(tables: Tables, database: str, root: str, buckets: int | None = None) -> None:
    """Catalog layout: every curated table as an external catalog table at
    ``<root>/<name>``; products and order lines also bucketed (and sorted) by
    sku into ``buckets`` buckets. Joins and groupings on sku over those two
    tables then need no shuffle: the dead-stock report aggregates the lines
    per sku and joins the products inside each bucket. Read it back with
    ``sources.from_catalog(spark, database)``.

    A bucket is read by one task, and a shuffle-free join gets no skew
    splitting, so this layout suits evenly spread skus; when one sku may
    hold a large share of the lines, the default layout (shuffle join with
    AQE skew handling) is the safer choice. Writes stay balanced either way:
    rows are range-split on (sku, unique key) before the bucketed write."""
    for name in LAYOUT:
        cluster, part = LAYOUT[name]
        df = curated_frame(tables, name)
        spark = df.sparkSession
        n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        keys = ([part] if part else []) + list(cluster)
        if name in BUCKETED_BY_SKU:
            # range split on (sku, unique key): a hot sku is written by several tasks
            keys = ["sku"] + [k for k in keys if k != "sku"]
        writer_df = df.repartitionByRange(n, *keys)
        writer = writer_df.write.mode("overwrite").option("path", f"{root}/{name}") \
            .option("maxRecordsPerFile", TARGET_ROWS_PER_FILE)
        if part:
            writer = writer.partitionBy(part)
        if name in BUCKETED_BY_SKU:
            writer = writer.bucketBy(n, "sku").sortBy("sku")
        writer.saveAsTable(f"{database}.{name}")


def bad_date_counts(tables: Tables) -> DataFrame:
    """Rows whose date text is present but not a valid date in either
    layout (such rows drop out of every period filter), per table: one
    aggregate per table, unioned."""
    parts = []
    for table, (parsed, text) in PARSED_DATES.items():
        df = tables[table]
        if text not in df.columns:
            continue
        present = F.col(text).isNotNull() & (F.col(text) != "")
        parts.append(df.agg(
            F.lit(table).alias("table"), F.lit(text).alias("column"),
            F.count_if(present).cast("bigint").alias("rows_with_text"),
            F.count_if(present & F.col(parsed).isNull()).cast("bigint").alias("unparseable")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
