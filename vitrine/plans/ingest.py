"""J1/J2 as queries: two overlapping sync batches merged by the keyed upsert.

The batches are cut from the search tables and turned back into landing
rows (what the search API returns): the first holds every day up to
2024-01-20, the second re-pulls every day from 2024-01-15 on with one more
click per row, as a late correction would. Together they cover the whole
table. The merged table must hold one row per key, with the second batch's
measures on the overlap.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bundle

from ..schemas import SEARCH_PAGE_KEYS, SEARCH_QUERY_KEYS, TABLES, curated_schema
from ..sources.tables import Tables
from ..session import scratch_dir
from ..streaming.upsert import QUARANTINE, flatten_landing, merge_newest, upsert_window
from ..operators.period import Period

FIRST_UNTIL = dt.date(2024, 1, 20)     # first batch: days up to here
SECOND_FROM = dt.date(2024, 1, 15)     # second batch: days from here on
STAMPS = (dt.datetime(2024, 1, 21, 6, 0), dt.datetime(2024, 1, 31, 6, 0))


def to_landing(rows: DataFrame, keys, extra_clicks: int = 0) -> DataFrame:
    """Typed rows -> landing rows ``keys[], clicks, impressions, ctr, position``."""
    clicks = (F.col("clicks") + extra_clicks).cast("double")
    impr = F.col("impressions").cast("double")
    return rows.select(
        F.array(*[F.col(k).cast("string") for k in keys]).alias("keys"),
        clicks.alias("clicks"), impr.alias("impressions"),
        F.when(impr > 0, clicks / impr).otherwise(F.lit(0.0)).alias("ctr"),
        F.col("position").cast("double").alias("position"))


def _two_batches(t: Tables, table: str, keys) -> DataFrame:
    src = t[table]
    batches = []
    cuts = ((F.col("day") <= F.lit(FIRST_UNTIL), 0), (F.col("day") >= F.lit(SECOND_FROM), 1))
    for (cut, extra), stamp in zip(cuts, STAMPS):
        batches.append(flatten_landing(to_landing(src.where(cut), keys, extra), keys, stamp))
    merged = merge_newest(None, batches, keys)
    return merged.drop("synced_at")


def upsert_queries(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """J1 merge on the query table's key (day, query, page, country, device)."""
    return _two_batches(t, "search_queries", SEARCH_QUERY_KEYS)


def upsert_pages(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """J2 merge on the page table's key (day, page)."""
    return _two_batches(t, "search_pages", SEARCH_PAGE_KEYS)


def upsert_into_target(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """O20 against a stored table: a target of the days up to 2024-01-20 is
    written, then one batch for 2024-01-15 to 2024-01-25 is upserted. The
    batch holds two pulls: the first raises every click count by 5, a later
    one corrects the mobile rows down to 2 more. Tablet rows are not pulled;
    one page is NULL. Days outside the batch keep their files."""
    src = t["search_queries"].withColumn("page", F.expr("nullif(page, '/p/3')"))
    keys = SEARCH_QUERY_KEYS
    path = scratch_dir(src.sparkSession, f"o20-{uuid.uuid4().hex}")
    stored = flatten_landing(to_landing(src.where(F.col("day") <= F.lit(FIRST_UNTIL)), keys), keys, STAMPS[0])
    upsert_window(src.sparkSession, stored, path, "search_queries", keys, None)
    window = Period(SECOND_FROM, dt.date(2024, 1, 25))
    pulls = []
    for rows, extra, hour in ((src.where("device <> 'TABLET'"), 5, 6), (src.where("device = 'MOBILE'"), 2, 7)):
        pulls.append(to_landing(rows, keys, extra).select(
            "*", F.lit(dt.datetime(2024, 1, 31, hour)).alias("pulled_at"), F.lit(f"pull-{hour}").alias("pulled_from")))
    batch = flatten_landing(pulls[0].unionByName(pulls[1]), keys, STAMPS[1])
    upsert_window(src.sparkSession, batch, path, "search_queries", keys, window)
    return src.sparkSession.read.schema(TABLES["search_queries"]).parquet(path).drop("synced_at")


def landing_pages(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """Search API read: the query table's rows landed as pages of 500 rows,
    checked to be one whole pull, and read back as typed rows."""
    from ..sources.pages import land_pages, read_pages

    src, keys = t["search_queries"], SEARCH_QUERY_KEYS
    folder = scratch_dir(src.sparkSession, f"s2-{uuid.uuid4().hex}")
    land_pages(to_landing(src, keys), ["keys"], folder, row_limit=500)
    return flatten_landing(read_pages(src.sparkSession, folder, row_limit=500), keys, STAMPS[0]) \
        .drop("synced_at", "pulled_at", "pulled_from")


def _land_files(t: Tables, folder: str) -> None:
    """Two pulls of both search tables as JSON lines, the second with one more
    click a row, and a third file with broken lines."""
    for table, keys in (("search_queries", SEARCH_QUERY_KEYS), ("search_pages", SEARCH_PAGE_KEYS)):
        src = t[table]
        for extra in (0, 1):
            rows = src if extra == 0 else src.where(F.col("day") >= F.lit(SECOND_FROM))
            to_landing(rows, keys, extra).write.mode("append").json(f"{folder}/{table}")
            time.sleep(0.01)                # the files of a later pull are newer
        days = src.select(F.col("day").cast("string").alias("day")).distinct()
        broken = days.select(F.explode(F.array(
            F.concat(F.lit('{"keys": ["'), "day", F.lit('", ')),                          # cut off
            F.concat(F.lit('{"keys": ["'), "day", F.lit('"], "clicks": 1.0}')),           # keys are missing
            F.concat(F.lit('{"keys": ["no day", "'), "day", F.lit('"], "clicks": 1.0}')))).alias("value"))
        broken.write.mode("append").text(f"{folder}/{table}")


def _synced(t: Tables, as_of: dt.date, **window) -> tuple[str, dict]:
    from ..streaming.upsert import sync_search

    spark = t["search_queries"].sparkSession
    folder = scratch_dir(spark, f"j-{uuid.uuid4().hex}")
    _land_files(t, f"{folder}/landing")
    for _ in range(2):                      # a second run of the same files changes nothing
        out = sync_search(spark, f"{folder}/landing/search_queries", f"{folder}/landing/search_pages", f"{folder}/tables", as_of,
                          synced_at=STAMPS[1], quarantine_root=f"{folder}/broken", **window)
    return folder, out


def sync_files(t: Tables, as_of: dt.date, table: str = "search_queries") -> DataFrame:
    """J1 / J2 as a whole: landing files with broken lines, the window of the
    seven days before ``as_of``, the stored table."""
    folder, _ = _synced(t, as_of)
    spark = t[table].sparkSession
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/tables/{table}").drop("synced_at")


def sync_windows(t: Tables, as_of: dt.date) -> DataFrame:
    """The default window and an explicit one, with the rows each run
    pulled, the days and rows it stored, and the broken lines set aside."""
    spark = t["search_queries"].sparkSession
    rows = None
    for name, window in (("default", {}), ("explicit", {"start": "2024-01-03", "end": "2024-01-04"})):
        folder, out = _synced(t, as_of, **window)
        start, end = out["period"].split(" -> ")
        for table in ("search_queries", "search_pages"):
            stored = spark.read.schema(TABLES[table]).parquet(f"{folder}/tables/{table}").agg(
                F.count(F.lit(1)).alias("stored"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
            kept_aside = spark.read.schema(QUARANTINE).parquet(f"{folder}/broken/{table}") \
                .select(F.count(F.lit(1)).alias("set_aside"))
            one = bundle(stored, kept_aside).select(
                F.lit(name).alias("run"), F.lit(table).alias("table"), F.lit(start).cast("date").alias("start"),
                F.lit(end).cast("date").alias("end"), F.lit(out[table]).cast("long").alias("pulled"), "stored", "first_day", "last_day",
                F.lit(out[f"{table}_broken"]).cast("long").alias("broken"), "set_aside")
            rows = one if rows is None else rows.unionByName(one)
    return rows


def tables_with_keys(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """Both tables created (twice, to no effect) and filled; a batch with
    rows that lack a required key is refused and leaves them as they are."""
    from ..streaming.upsert import KeyViolation, ensure_table

    spark = t["search_queries"].sparkSession
    rows = None
    for table, keys in (("search_queries", SEARCH_QUERY_KEYS), ("search_pages", SEARCH_PAGE_KEYS)):
        path = scratch_dir(spark, f"j4-{uuid.uuid4().hex}")
        ensure_table(spark, path, table)
        created = spark.read.schema(TABLES[table]).parquet(path).count()
        batch = flatten_landing(to_landing(t[table], keys), keys, STAMPS[0])
        upsert_window(spark, batch, path, table, keys, None)
        ensure_table(spark, path, table)
        required = keys[1]
        try:
            upsert_window(spark, batch.withColumn(required, F.nullif(required, F.min(required).over(Window.partitionBy("day")))),
                          path, table, keys, None)
            refused = False
        except KeyViolation:
            refused = True
        one = spark.read.schema(TABLES[table]).parquet(path).agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*keys)).cast("long").alias("keys")).select(
            F.lit(table).alias("table"), F.lit(created).cast("long").alias("rows_at_first"), "rows", "keys", F.lit(refused).alias("refused"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _changed_source(t: Tables) -> Tables:
    """Sales moved to another month, cancelled, undated, deleted."""
    k = F.col("sale_id")
    day = (F.when(k % 90 == 2, F.add_months("sale_date", 3)).when(k % 90 == 4, F.lit(None))
           .otherwise(F.col("sale_date")))
    changed = t["sales"].where(k % 90 != 1).withColumn("sale_date", day).withColumn(
        "status", F.when(k % 90 == 5, F.lit("Cancelado")).otherwise(F.col("status")))
    return Tables({"sales": lambda: changed, "sale_items": lambda: t["sale_items"]})


def _curated_after_changes(t: Tables, summaries: bool) -> str:
    """Root of sales and lines curated, changed in the source, and refreshed
    for one unrelated month."""
    from ..sources.curated import write_curated

    root = scratch_dir(t["sales"].sparkSession, f"s4-{uuid.uuid4().hex}")
    names = ["sales", "sale_items"]
    write_curated(Tables({n: (lambda n=n: t[n]) for n in names}), root, names=names, summaries=summaries)
    write_curated(_changed_source(t), root, names=names, refresh=Period(dt.date(2000, 2, 1), dt.date(2000, 2, 29)), summaries=summaries)
    return root


def _sales_with_lines(spark, root: str) -> DataFrame:
    """The curated sales with the number and value of their lines."""
    sales, lines = (spark.read.schema(curated_schema(n)).parquet(f"{root}/{n}") for n in ("sales", "sale_items"))
    # grouped and joined by the same columns, so a group does not move twice; NULLs inside a struct are equal
    per_sale = lines.groupBy("sale_id", F.struct("sale_date", F.col("sale_status").alias("status")).alias("copied")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("line_total").cast("decimal(38,2)").alias("line_total"))
    own = sales.select("sale_id", F.struct("sale_date", "status").alias("copied"))
    return own.join(per_sale, ["sale_id", "copied"], "left").select(
        "sale_id", "copied.sale_date", "copied.status", F.coalesce("lines", F.lit(0)).alias("lines"), "line_total")


def curated_refresh(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """Load step: curate sales and lines, change the source (sales moved to
    another month, cancelled, undated, deleted), refresh one unrelated month,
    and return the refreshed sales with the number and value of their lines."""
    return _sales_with_lines(t["sales"].sparkSession, _curated_after_changes(t, summaries=False))


def summaries_after_changes(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """Load step: the kept summaries after the changes of ``curated_refresh``:
    day sums, last date of each customer, last live sale of each sku."""
    from ..sources.kept import read_summary

    spark, root = t["sales"].sparkSession, _curated_after_changes(t, summaries=True)
    none = {"day": F.lit(None).cast("date"), "n": F.lit(None).cast("bigint"), "revenue": F.lit(None).cast("decimal(38,2)"),
            "discount": F.lit(None).cast("decimal(38,2)")}
    days = read_summary(spark, root, "sales_days").select(
        F.lit("day").alias("kind"), F.col("sale_date").cast("string").alias("key"), none["day"].alias("last_date"),
        F.col("orders"), "revenue", "discount")
    last = [read_summary(spark, root, name).select(
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "last_date", none["n"].alias("orders"),
        none["revenue"].alias("revenue"), none["discount"].alias("discount"))
        for name, kind, key in (("customer_state", "customer", "customer_id"), ("sku_state", "sku", "sku"))]
    return days.unionByName(last[0]).unionByName(last[1])


def incremental_pull(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """PostgreSQL scan: sales and lines pulled whole, changed in the source
    (new, moved, cancelled, undated, deleted sales, lines of a sale gone; the
    changed ones with a new stamp), pulled again from the mark on, and returned
    with the number and value of their lines."""
    from ..sources.pull import FrameChanges, pull_sales

    spark = t["sales"].sparkSession
    root = scratch_dir(spark, f"s1-{uuid.uuid4().hex}")
    k = F.col("sale_id")
    late = k % 90 == 7                                      # not there at first
    first = Tables({"sales": lambda: t["sales"].where(~late), "sale_items": lambda: t["sale_items"].where(~late)})
    pull_sales(spark, FrameChanges(first), root)
    day = (F.when(k % 90 == 2, F.date_format(F.add_months("sale_date", 3), "yyyy-MM-dd")).when(k % 90 == 4, F.lit(""))
           .otherwise(F.col("sale_date_text")))
    changed = t["sales"].where(k % 90 != 1).withColumn("sale_date_text", day).withColumn(
        "status", F.when(k % 90 == 5, F.lit("Cancelado")).otherwise(F.col("status"))).withColumn(
        "synced_at_text", F.when((k % 90).isin(2, 4, 5, 6, 7), F.lit("2002-01-01 00:00:00")).otherwise(F.col("synced_at_text"))).drop("sale_date")
    lines = t["sale_items"].where(~((k % 90 == 6) & (F.col("quantity") > 25)))
    pull_sales(spark, FrameChanges(Tables({"sales": lambda: changed, "sale_items": lambda: lines})), root)
    return _sales_with_lines(spark, root)


def bad_dates(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """O1: per table the rows with a date text, and those of them that are no
    valid date in either layout."""
    from ..sources.curated import bad_date_counts
    return bad_date_counts(t)
