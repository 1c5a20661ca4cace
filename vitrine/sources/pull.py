"""Incremental pull of sales and their lines from the operational database.

The database stamps every sale it writes (``synced_at``). A pull reads the sales
stamped since the last pull's high-water mark, less an overlap for transactions
that committed late, and their lines: only changed rows. Deleted sales leave no
stamp, so the keys alone are compared as well, source against stored.

Rows met again in the overlap change nothing: sales are compared with the stored
ones by a digest over the sale and its lines. What differs decides the months to
rewrite, the old month and the new one of each sale. Those months are staged for
both tables, then a journal names them, then they replace the stored
partitions, and last the mark moves on. A run that dies in between is completed from
the journal by the next one, so sales and lines cannot part.

A sale changed without a new stamp is not seen here; ``write_curated(refresh=...)``
compares whole months and is the audit for that. Rows without a readable stamp are
read by every pull.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_timestamp
from ..schemas import TABLES, curated_schema
from ..session import path_exists, remove_path, scratch_dir
from . import kept
from .curated import LAYOUT, among, curated_frame, forget_digests, replace_partitions, stage, typed, write_curated
from .tables import Tables

PAIR = ("sales", "sale_items")
OVERLAP = dt.timedelta(hours=1)
_JOURNAL = "name string, staging string, sale_month date"
_MARK = "mark timestamp_ntz"


def stamped_since(since: dt.datetime | None) -> Column:
    """Sales written at or after ``since``, and those without a stamp."""
    stamp = parse_timestamp("synced_at_text")
    return F.lit(True) if since is None else stamp.isNull() | (stamp >= F.lit(since).cast("timestamp_ntz"))


class FrameChanges:
    """Changes of a source given as tables with the engine's columns."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def sales(self, since: dt.datetime | None) -> DataFrame:
        return self.tables["sales"].where(stamped_since(since))

    def lines(self, since: dt.datetime | None, sales: DataFrame | None = None) -> DataFrame:
        """Lines of the sales written since; ``sales``: those, if they were read already."""
        ids = (self.sales(since) if sales is None else sales).select("sale_id")
        return self.tables["sale_items"].join(ids, "sale_id", "left_semi")

    def keys(self) -> DataFrame:
        return self.tables["sales"].select("sale_id")


def _state(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/_pull/{name}"


def read_mark(spark: SparkSession, root: str) -> dt.datetime | None:
    path = _state(root, "mark")
    return spark.read.schema(_MARK).parquet(path).first()["mark"] if path_exists(spark, path) else None


def _write_mark(spark: SparkSession, root: str, mark: dt.datetime | None) -> None:
    if mark is not None:
        spark.createDataFrame([(mark,)], _MARK).coalesce(1).write.mode("overwrite").parquet(_state(root, "mark"))


def _width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def complete(spark: SparkSession, root: str) -> bool:
    """Finish the swap that a journal describes; whether there was one."""
    path = _state(root, "journal")
    if not path_exists(spark, path):
        return False
    months: dict[str, set] = {}
    staging: dict[str, str] = {}
    for r in spark.read.schema(_JOURNAL).parquet(path).collect():      # a row per table and month
        months.setdefault(r["name"], set()).add(r["sale_month"])
        staging[r["name"]] = r["staging"]
    in_use = {name: kept.suspend(spark, root, name) for name in staging}
    for name, place in staging.items():
        replace_partitions(spark.read.schema(curated_schema(name)).parquet(place), root, name, months[name], None)
        forget_digests(spark, root, name)
    for name in staging:
        kept.update(spark, root, name, months[name] if in_use[name] else None)
    remove_path(spark, path)
    for place in staging.values():
        remove_path(spark, place)
    return True


def _digests(sales: DataFrame, lines: DataFrame, side: str) -> DataFrame:
    """Per sale an order-free digest of its row and its lines."""
    hashes = None
    for df in (sales, lines):
        cols = sorted(c for c in df.columns if c != "sale_month")
        one = df.select("sale_id", F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit(1), *cols).alias("g"))
        hashes = one if hashes is None else hashes.unionByName(one)
    return hashes.groupBy("sale_id").agg(F.struct(
        F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.shiftright("g", 24))).alias(side))


def _lines(source, since: dt.datetime | None, sales: DataFrame) -> DataFrame:
    """Lines of the sales just read; a database joins them itself."""
    return source.lines(since, sales) if isinstance(source, FrameChanges) else source.lines(since)


def pull_sales(spark: SparkSession, source, root: str, overlap: dt.timedelta = OVERLAP, compare_keys: bool = True) -> dict:
    """Bring the curated sales and lines at ``root`` up to date with ``source``
    (``sales(since)``, ``lines(since)``, ``keys()``).

    Without stored tables the source is written whole; without a mark all sales
    are read and compared. ``compare_keys=False`` skips the look for deleted
    sales. Returns rows read, sales changed and deleted, and months rewritten."""
    root = root.rstrip("/")
    complete(spark, root)
    stored_there = path_exists(spark, f"{root}/sales")
    mark = read_mark(spark, root) if stored_there else None
    since = None if mark is None else mark - overlap
    run = scratch_dir(spark, f"pull-{uuid.uuid4().hex}")

    # what the source holds now, read once
    seen, seen_lines = Observation(), Observation()
    sales_cols, line_cols = ([f.name for f in TABLES[n].fields] for n in PAIR)
    stage(source.sales(since).select(*sales_cols).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.max(parse_timestamp("synced_at_text")).alias("mark")), f"{run}/sales")
    got = Tables({n: (lambda n=n: spark.read.schema(TABLES[n]).parquet(f"{run}/{n}")) for n in PAIR})
    lines = _lines(source, since, got["sales"]).select(*line_cols)
    report = {"sales_read": seen.get["rows"], "changed": 0, "deleted": 0, "months": 0}
    new_mark = max((m for m in (mark, seen.get["mark"]) if m is not None), default=None)
    if not stored_there:
        # all lines go from the source to their months, their sales' columns on the way
        write_curated(Tables({"sales": lambda: got["sales"], "sale_items": lambda: lines}), root, names=list(PAIR))
        _write_mark(spark, root, new_mark)
        remove_path(spark, run)
        lines_stored = spark.read.schema(curated_schema("sale_items")).parquet(f"{root}/sale_items").count()
        return {**report, "lines_read": lines_stored, "changed": report["sales_read"]}
    stage(lines.observe(seen_lines, F.count(F.lit(1)).alias("rows")), f"{run}/sale_items")
    report["lines_read"] = seen_lines.get["rows"]

    new = {n: typed(curated_frame(got, n), n) for n in PAIR}
    old = {n: spark.read.schema(curated_schema(n)).parquet(f"{root}/{n}") for n in PAIR}
    ids = got["sales"].select("sale_id").distinct()
    # where the sales read now were stored: two narrow columns of the stored table
    place = old["sales"].select("sale_id", "sale_month")
    before = {r[0] for r in place.join(ids, "sale_id", "left_semi").select("sale_month").distinct().collect()}
    was = _digests(*(old[n].where(among("sale_month", before)).join(ids, "sale_id", "left_semi") for n in PAIR), "was")
    differ = _digests(new["sales"], new["sale_items"], "now").join(was, "sale_id", "left") \
        .where(~F.col("now").eqNullSafe(F.col("was"))).select("sale_id", F.lit(False).alias("deleted"))
    if compare_keys:
        gone = place.select("sale_id").join(source.keys(), "sale_id", "left_anti").distinct()
        differ = differ.unionByName(gone.select("sale_id", F.lit(True).alias("deleted")))
    differ.write.parquet(f"{run}/touched")
    touched = spark.read.schema("sale_id long, deleted boolean").parquet(f"{run}/touched")
    counts = touched.agg(F.count_if("deleted").alias("gone"), F.count_if(~F.col("deleted")).alias("changed")).first()
    report |= {"changed": counts["changed"], "deleted": counts["gone"]}

    changed = touched.where(~F.col("deleted")).select("sale_id")
    months = {r[0] for r in place.join(touched, "sale_id", "left_semi").select("sale_month").unionByName(
        new["sales"].join(changed, "sale_id", "left_semi").select("sale_month")).distinct().collect()}
    if months:
        journal = []
        for name in PAIR:
            staging = scratch_dir(spark, f"pull-{name}-{uuid.uuid4().hex}")
            # stored rows are in order and stay in it; only the new ones are put in order
            rest = old[name].where(among("sale_month", months)).join(touched, "sale_id", "left_anti")
            fresh = new[name].join(changed, "sale_id", "left_semi").repartitionByRange(_width(spark), *LAYOUT[name][0])
            stage(rest.unionByName(fresh), staging)
            journal += [(name, staging, m) for m in months]
        spark.createDataFrame(journal, _JOURNAL).coalesce(1).write.parquet(_state(root, "journal"))
        complete(spark, root)
    _write_mark(spark, root, new_mark)
    remove_path(spark, run)
    return {**report, "months": len(months)}
