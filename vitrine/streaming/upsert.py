"""Search statistics ingest: landing rows -> typed rows -> keyed upsert.

O21 flatten_landing  API rows {keys[], clicks, impressions, ctr, position}
                     -> typed columns; ctr rounded to 4, position to 2
O20 merge_newest     insert new keys, replace the measures of existing keys
J1/J2 sync_table     one sync run for the query table or the page table
      stream_sync    the same as a Structured Streaming job over a landing
                     folder (foreachBatch + availableNow)

Plain parquet has no MERGE. The upsert touches only the ``day`` partitions
that the batch has rows for: it reads those partitions (partition pruning on
the days, known at plan time), unions the batch, keeps the newest row
per key, stages the result in the shared checkpoint folder (cutting the
lineage to the target it is about to replace) and overwrites just those
partitions (dynamic partition overwrite). Running the same batch twice
gives the same table.

Newest row per key: a later batch beats an earlier one; inside one batch the
row of the landing file written last wins (then the later file name), so a
correction replaces an earlier pull even where it lowers a count; the
measures only break ties inside one file, so reruns stay deterministic.
The winner is picked by an aggregate (max of a struct), which combines
map-side, so even a key repeated across a third of the batch shuffles only
one row per task. A NULL ``page`` counts as equal to another NULL page.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.period import Period
from ..schemas import LANDING, SEARCH_MEASURES, SEARCH_PAGE_KEYS, SEARCH_QUERY_KEYS, TABLES
from ..session import path_exists, remove_path, scratch_dir
from ..sources import kept


def flatten_landing(landing: DataFrame, key_names: Sequence[str],
                    synced_at: dt.datetime | None = None) -> DataFrame:
    """``keys`` array to named columns (``day`` parsed as DATE), counts
    to INT, ctr rounded to 4 and position to 2 decimals."""
    keys = [F.element_at("keys", i + 1).alias(name) for i, name in enumerate(key_names)]
    landing = checked(landing, key_names)
    typed = landing.select(
        *keys, *[F.col(c) for c in PULL if c in landing.columns],
        F.round("clicks").cast("int").alias("clicks"),
        F.round("impressions").cast("int").alias("impressions"),
        F.round("ctr", 4).cast("decimal(6,4)").alias("ctr"),
        F.round("position", 2).cast("decimal(6,2)").alias("position"))
    typed = typed.withColumn("day", F.col("day").cast("date"))
    stamp = F.lit(synced_at).cast("timestamp_ntz") if synced_at else F.localtimestamp()
    return typed.withColumn("synced_at", stamp)


KEYS = {"search_queries": SEARCH_QUERY_KEYS, "search_pages": SEARCH_PAGE_KEYS}
# of the landing file a row came from; absent for rows without a file
PULL = ("pulled_at", "pulled_from")


def _with_file(landing: DataFrame) -> DataFrame:
    return landing.select("*", F.col("_metadata.file_modification_time").alias("pulled_at"),
                          F.col("_metadata.file_path").alias("pulled_from"))


def checked(landing: DataFrame, key_names: Sequence[str]) -> DataFrame:
    """Fail on rows without a valid key list."""
    day = F.element_at("keys", 1)
    good = (F.size("keys") == len(key_names)) & day.try_cast("date").isNotNull()
    where = F.col("pulled_from") if "pulled_from" in landing.columns else F.lit("the batch")
    return landing.withColumn("keys", F.when(F.coalesce(good, F.lit(False)), F.col("keys")).otherwise(
        F.raise_error(F.concat(F.lit("broken landing row in "), where)).cast("array<string>")))


def merge_newest(target: DataFrame | None, batches: Sequence[DataFrame],
                 keys: Sequence[str], measures: Sequence[str] = SEARCH_MEASURES) -> DataFrame:
    """O20 on DataFrames: rows of ``target`` and then each batch in order;
    per key the row from the latest source wins (its measures replace the
    old ones). Returns one row per key."""
    sources = ([] if target is None else [target]) + list(batches)
    pull = (F.lit(None).cast("timestamp"), F.lit(None).cast("string"))
    tagged = [df.select(*keys, *measures, "synced_at", F.lit(i).alias("_src"),
                        *[(F.col(c) if c in df.columns else none).alias(f"_{c}") for c, none in zip(PULL, pull)])
              for i, df in enumerate(sources)]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df)
    rank = F.struct("_src", *[f"_{c}" for c in PULL], *measures, "synced_at")
    payload = F.struct(*[F.col(m) for m in measures], F.col("synced_at"))
    newest = union.groupBy(*keys).agg(F.max_by(payload, rank).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{m}").alias(m) for m in (*measures, "synced_at")])


def _read_table(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The existing table, or None before the first run. A table that is there
    but cannot be read is not an absent one: that fails when it is read."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else None


class KeyViolation(ValueError):
    """A batch breaks a table's key; the table is unchanged."""


def upsert_window(spark: SparkSession, batch: DataFrame, table_path: str, table: str,
                  keys: Sequence[str], window: Period | None) -> int:
    """Upsert ``batch`` (typed rows) into the parquet table at ``table_path``,
    partitioned by ``day``; rows outside ``window`` are not part of the run.
    Only the days that the batch holds are read and rewritten. Returns the
    number of rows pulled (the batch's rows in the window).

    The batch is evaluated once, into the checkpoint folder; its rows and the
    empty key columns among them are counted in that write (``observe``), so no
    pass is made for the check. A row without a required key column (NOT NULL in
    the schema) fails the run before the stored table changes; uniqueness is the
    merge's own result, one row per key. Summaries kept beside the table follow
    for the days of the batch."""
    schema = TABLES[table]
    cols = [f.name for f in schema.fields]
    required = [f.name for f in schema.fields if not f.nullable]
    if window is not None:
        batch = batch.where(F.col("day").between(F.lit(window.start), F.lit(window.end)))
    pulled = Observation()
    carried = [c for c in (*cols, *PULL) if c in batch.columns]
    staging = [scratch_dir(spark, f"upsert-{table}-{uuid.uuid4().hex}") for _ in range(2)]
    batch.select(carried).observe(
        pulled, F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in required]).write.parquet(staging[0])
    counts = pulled.get
    empty = {c: counts[c] for c in required if counts[c]}
    if empty:
        remove_path(spark, staging[0])
        raise KeyViolation(f"{table}: rows without a required key column: {empty}")
    if not counts["rows"]:
        remove_path(spark, staging[0])
        return 0
    batch = spark.read.schema(batch.select(carried).schema).parquet(staging[0])
    days = sorted(r["day"] for r in batch.select("day").distinct().collect())      # calendar days of the batch
    target = _read_table(spark, table_path, schema)
    if target is not None:
        target = target.where(F.col("day").isin(days)).select(*cols)
    merge_newest(target, [batch], keys).select(*cols).write.parquet(staging[1])
    staged = spark.read.schema(schema).parquet(staging[1])
    root, name = table_path.rstrip("/").rsplit("/", 1)
    summary = name == table and table in kept.GROUPS and kept.suspend(spark, root, table)
    # clustered by day, so a write task opens the files of few days
    (staged.repartitionByRange("day", *[k for k in keys if k != "day"]).sortWithinPartitions(*keys)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(table_path))
    if summary:
        kept.update(spark, root, table, set(days))
    for path in staging:
        remove_path(spark, path)
    return counts["rows"]


def read_landing(spark: SparkSession, landing_path: str) -> DataFrame:
    """Landing rows with their file's time and name. A line that is not JSON
    of the landing layout fails the run: no row is lost without notice."""
    return _with_file(spark.read.schema(LANDING).option("mode", "FAILFAST").json(landing_path))


def split_landing(spark: SparkSession, landing_path: str, key_names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(good landing rows, broken ones) of a folder. Broken: a line that is
    not JSON of the landing layout, or without a valid key list; with reason,
    the line and its file."""
    layout = T.StructType([*LANDING.fields, T.StructField("_broken", T.StringType())])
    rows = _with_file(spark.read.schema(layout).option("columnNameOfCorruptRecord", "_broken").json(landing_path))
    present = [f.name for f in TABLES["search_queries" if len(key_names) > 2 else "search_pages"].fields if not f.nullable]
    keys = (F.size("keys") == len(key_names)) & F.element_at("keys", 1).try_cast("date").isNotNull()
    for name in present[1:]:
        keys &= F.get("keys", F.lit(list(key_names).index(name))).isNotNull()
    reason = F.when(F.col("_broken").isNotNull(), F.lit("not JSON of the landing layout")) \
        .when(~F.coalesce(keys, F.lit(False)), F.lit("no valid key list"))
    judged = rows.withColumn("reason", reason)
    line = F.coalesce("_broken", F.to_json(F.struct(*LANDING.names)))
    bad = judged.where(F.col("reason").isNotNull()).select("reason", line.alias("line"), F.col("pulled_from").alias("file"), "pulled_at")
    return judged.where(F.col("reason").isNull()).drop("_broken", "reason"), bad


QUARANTINE = "reason string, line string, file string, pulled_at timestamp"


def quarantine(spark: SparkSession, bad: DataFrame, path: str) -> int:
    """Store broken rows, each once however often its file is read, and return
    how many the run met."""
    counted = Observation()
    staging = scratch_dir(spark, f"quarantine-{uuid.uuid4().hex}")
    bad.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(staging)
    if counted.get["rows"]:
        new = spark.read.schema(QUARANTINE).parquet(staging).dropDuplicates(["file", "line", "pulled_at"])
        if path_exists(spark, path):
            known = spark.read.schema(QUARANTINE).parquet(path).select("file", "line", "pulled_at")
            new = new.join(known, ["file", "line", "pulled_at"], "left_anti")
        new.write.mode("append").parquet(path)
    remove_path(spark, staging)
    return counted.get["rows"]


def sync_table(spark: SparkSession, landing_path: str, table_path: str, table: str,
               window: Period, synced_at: dt.datetime | None = None, quarantine_path: str | None = None) -> int | tuple[int, int]:
    """J1 (table='search_queries') or J2 (table='search_pages').

    Without ``quarantine_path`` a broken landing row fails the run; with it,
    such rows are stored there, the others land, and (rows pulled, rows broken)
    is returned."""
    keys = KEYS[table]
    if quarantine_path is None:
        typed = flatten_landing(read_landing(spark, landing_path), keys, synced_at)
        return upsert_window(spark, typed, table_path, table, keys, window)
    good, bad = split_landing(spark, landing_path, keys)
    broken = quarantine(spark, bad, quarantine_path)
    return upsert_window(spark, flatten_landing(good, keys, synced_at), table_path, table, keys, window), broken


def stream_sync(spark: SparkSession, landing_dir: str, table_path: str, table: str,
                window: Period | None, checkpoint_location: str):
    """Structured Streaming variant: every new landing file is upserted as
    it arrives (``foreachBatch``); ``availableNow`` drains what is there and
    stops. The stream checkpoint makes each file count once.

    Without a fixed ``window``, each micro-batch upserts just the days it
    holds."""
    keys = KEYS[table]
    stream = _with_file(spark.readStream.schema(LANDING).option("mode", "FAILFAST").json(landing_dir))

    def apply(batch_df: DataFrame, batch_id: int) -> None:
        upsert_window(batch_df.sparkSession, flatten_landing(batch_df, keys), table_path, table, keys, window)

    return (stream.writeStream.foreachBatch(apply)
            .option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True).start())


def ensure_table(spark: SparkSession, table_path: str, table: str) -> None:
    """Create the table (empty, with its schema, partitioned by day) if
    it does not exist yet; a no-op otherwise. Key uniqueness is kept by the
    upsert, as Spark does not enforce keys."""
    if _read_table(spark, table_path, TABLES[table]) is None:
        (spark.createDataFrame([], TABLES[table]).write.mode("ignore")
         .partitionBy("day").parquet(table_path))


def sync_search(spark: SparkSession, landing_queries: str, landing_pages: str, root: str,
                as_of: dt.date, days: int = 7, start=None, end=None,
                synced_at: dt.datetime | None = None, quarantine_root: str | None = None) -> dict:
    """One sync run: the J3 window (``days`` days ending the day before
    ``as_of``, or explicit bounds), then J1 and J2 into ``<root>/<table>``.
    Returns the window and the rows written per table; with
    ``quarantine_root``, where broken rows go, also their number."""
    from ..operators.period import sync_window
    window = sync_window(as_of, days, start, end)
    out = {"period": f"{window.start.isoformat()} -> {window.end.isoformat()}"}
    for table, landing in (("search_queries", landing_queries), ("search_pages", landing_pages)):
        ensure_table(spark, f"{root}/{table}", table)
        bad = f"{quarantine_root}/{table}" if quarantine_root else None
        got = sync_table(spark, landing, f"{root}/{table}", table, window, synced_at, bad)
        out[table], broken = got if bad else (got, 0)
        if bad:
            out[f"{table}_broken"] = broken
    return out
