"""Summaries the load step keeps beside the curated tables.

Per day of the sales: counts and sums. Per customer and month, and per sku and
month: the last date; from these the state of each customer (last sale, cancelled
included) and of each sku (last live sale). Per day of the search tables: sums,
and exact distinct sets: every query and page text has a dense number, and a day
stores which numbers occur as bitmaps of 32,768 bits, which merge by OR over any
range of days.

A refresh rewrites the summaries of the changed months or days alone. A maximum
cannot be taken back, so the state of a customer or sku is recomputed from its
monthly rows, only for those that had or have a row in a changed month.

Queries read a summary in place of the base table where it is there. Each group
has a marker that is taken away before its base tables change and set again
after the summaries are written: a broken run leaves no summary in use, and the
next one rebuilds the group whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import count_where, money_sum, not_cancelled
from ..session import COMPRESSION, path_exists, remove_path, scratch_dir
from ..schemas import curated_schema

_D, _L, _S, _M = T.DateType(), T.LongType(), T.StringType(), T.DecimalType(38, 2)


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: group -> summary -> schema; the partition column is the last one, if any
GROUPS = {
    "sales": {
        "sales_days": _schema(sale_date=_D, orders=_L, revenue=_M, discount=_M, sale_month=_D),
        "customer_months": _schema(customer_id=_L, last_date=_D, sale_month=_D),
        "customer_state": _schema(customer_id=_L, last_date=_D)},
    "sale_items": {
        "sku_months": _schema(sku=_S, last_date=_D, sale_month=_D),
        "sku_state": _schema(sku=_S, last_date=_D)},
    "search_queries": {
        "search_days": _schema(clicks=_L, impressions=_L, weight=T.DecimalType(38, 2), day=_D),
        "search_day_keys": _schema(kind=_S, bucket=_L, bits=T.BinaryType(), day=_D),
        "search_keys": _schema(kind=_S, key=_S, id=_L)},
}
SUMMARIES = {name: schema for group in GROUPS.values() for name, schema in group.items()}
PART = {"sales": "sale_month", "sale_items": "sale_month", "search_queries": "day"}


def _marker(root: str, group: str) -> str:
    return f"{root.rstrip('/')}/_kept/{group}"


def in_use(spark: SparkSession, root: str, group: str) -> bool:
    return path_exists(spark, _marker(root, group))


def suspend(spark: SparkSession, root: str, group: str) -> bool:
    """Take the group out of use before its base table changes; whether it
    was in use."""
    was = in_use(spark, root, group)
    if was:
        remove_path(spark, _marker(root, group))
    return was


def read_summary(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SUMMARIES[name]).parquet(f"{root.rstrip('/')}/{name}")


def _among(part: str, values) -> Column:
    """Rows of these partitions (None: all; undated ones have no summary)."""
    if values is None:
        return F.col(part).isNotNull()
    dated = sorted(v for v in values if v is not None)
    return F.col(part).isin(dated) if dated else F.lit(False)


def _parts(df: DataFrame, root: str, name: str, part: str, values) -> None:
    """Replace the partitions ``values`` of a summary (None: all of it)."""
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{name}"
    out = df.select([f.name for f in SUMMARIES[name].fields]).repartition(part).write.mode("overwrite").option("compression", COMPRESSION)
    if values is None:
        out.partitionBy(part).parquet(path)
        return
    present = {r[0] for r in df.select(part).distinct().collect()}      # at most one per changed month or day
    if present:
        out.option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    for v in values:
        if v is not None and v not in present:
            remove_path(spark, f"{path}/{part}={v.isoformat()}")


def _swap(df: DataFrame, root: str, name: str) -> None:
    """Replace a summary whole by rows that may be read from it."""
    spark = df.sparkSession
    staging = scratch_dir(spark, f"kept-{name}-{uuid.uuid4().hex}")
    df.select([f.name for f in SUMMARIES[name].fields]).write.option("compression", COMPRESSION).parquet(staging)
    spark.read.schema(SUMMARIES[name]).parquet(staging).write.mode("overwrite").option("compression", COMPRESSION) \
        .parquet(f"{root.rstrip('/')}/{name}")
    remove_path(spark, staging)


def _most(base: DataFrame, values) -> bool:
    """Whether more than half of the table's months are among ``values``."""
    there = {r[0] for r in base.select("sale_month").distinct().collect()} - {None}      # a row a month
    return 2 * len(there & set(values)) > len(there)


def _last_dates(base: DataFrame, root: str, key: str, months: str, state: str, values) -> None:
    """Monthly last dates of the changed months, and the state of the keys
    that had or have a row there (of all keys, if most months changed)."""
    spark = base.sparkSession
    new = base.where(_among("sale_month", values)).groupBy(key, "sale_month").agg(F.max("sale_date").alias("last_date"))
    if values is None or _most(base, values):
        _parts(new, root, months, "sale_month", values)
        rows = read_summary(spark, root, months)
        state_rows = rows.groupBy(key).agg(F.max("last_date").alias("last_date")).select([f.name for f in SUMMARIES[state].fields])
        state_rows.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{root.rstrip('/')}/{state}")
        return
    had = read_summary(spark, root, months).where(_among("sale_month", values)).select(key)
    staging = scratch_dir(spark, f"kept-touched-{uuid.uuid4().hex}")
    had.union(new.select(key)).distinct().write.parquet(staging)
    touched = spark.read.schema(T.StructType([SUMMARIES[state][key]])).parquet(staging).withColumnRenamed(key, "touched")
    _parts(new, root, months, "sale_month", values)
    same = F.col(key).eqNullSafe(F.col("touched"))
    again = read_summary(spark, root, months).join(touched, same, "left_semi").groupBy(key).agg(F.max("last_date").alias("last_date"))
    _swap(read_summary(spark, root, state).join(touched, same, "left_anti").select(key, "last_date").unionByName(again), root, state)
    remove_path(spark, staging)


def number_rows(df: DataFrame, key: list[str], start: Column, name: str = "id") -> DataFrame:
    """Dense numbers ``start`` + 1, 2, ... in the order of the (unique) keys:
    ranges are written once, so they stay what they are, counted, and each row
    is numbered inside its range."""
    spark = df.sparkSession
    staging = scratch_dir(spark, f"ranges-{uuid.uuid4().hex}")
    df.repartitionByRange(*key).withColumn("_range", F.spark_partition_id()).write.parquet(staging)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(staging)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))      # a row per range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*key))
    return rows.join(F.broadcast(counts), "_range").select(*df.columns, (start + F.col("_before") + inside).cast("long").alias(name))


def _day_keys(base: DataFrame, root: str, values) -> None:
    """Numbers for the new texts, and the bitmaps of the changed days."""
    spark = base.sparkSession
    rows = base.where(_among("day", values))
    seen = rows.select("day", F.inline(F.array(
        F.struct(F.lit("page").alias("kind"), F.col("page").alias("key")),
        F.struct(F.lit("query").alias("kind"), F.col("query").alias("key"))))).where("key IS NOT NULL").distinct()
    path = f"{root.rstrip('/')}/search_keys"
    texts = seen.select("kind", "key").distinct()
    if values is None:
        number_rows(texts, ["kind", "key"], F.lit(0)).write.mode("overwrite").parquet(path)
    else:
        known = read_summary(spark, root, "search_keys")
        top = known.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
        staging = scratch_dir(spark, f"kept-keys-{uuid.uuid4().hex}")
        number_rows(texts.join(known, ["kind", "key"], "left_anti"), ["kind", "key"], top).write.parquet(staging)
        spark.read.schema(SUMMARIES["search_keys"]).parquet(staging).write.mode("append").parquet(path)
        remove_path(spark, staging)
    bits = seen.join(read_summary(spark, root, "search_keys"), ["kind", "key"]) \
        .groupBy("day", "kind", F.bitmap_bucket_number("id").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    _parts(bits, root, "search_day_keys", "day", values)


def update(spark: SparkSession, root: str, group: str, values=None) -> None:
    """Write the group's summaries from the curated table at ``root``: of the
    partitions ``values`` (months or days), or all; then put it in use."""
    base = spark.read.schema(curated_schema(group)).parquet(f"{root.rstrip('/')}/{group}")
    if group == "sales":
        live = not_cancelled()
        days = base.where(_among("sale_month", values)).groupBy("sale_month", "sale_date").agg(
            count_where(live).alias("orders"), money_sum("total", live).alias("revenue"), money_sum("discount", live).alias("discount"))
        _parts(days, root, "sales_days", "sale_month", values)
        _last_dates(base, root, "customer_id", "customer_months", "customer_state", values)
    elif group == "sale_items":
        _last_dates(base.where(not_cancelled("sale_status") & F.col("sku").isNotNull()), root, "sku", "sku_months", "sku_state", values)
    else:
        days = base.where(_among("day", values)).groupBy("day").agg(
            F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
            F.sum(F.col("position") * F.col("impressions")).cast("decimal(38,2)").alias("weight"))
        _parts(days, root, "search_days", "day", values)
        _day_keys(base, root, values)
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(_marker(root, group))


def distinct_keys(day_keys: DataFrame, kind: str, by: list[Column] | None = None) -> DataFrame:
    """Number of distinct texts of a kind over the days given (per group
    ``by``), as column ``n``: bitmaps merged per bucket, then their bits added."""
    names = [f"_by{i}" for i in range(len(by or []))]
    rows = day_keys.where(F.col("kind") == kind).select(*[c.alias(n) for c, n in zip(by or [], names)], "bucket", "bits")
    merged = rows.groupBy(*names, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return merged.groupBy(*names).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
