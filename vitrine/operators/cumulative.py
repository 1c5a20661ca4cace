"""Cumulative-share (ABC / Pareto) classes.

Rows are ranked by ``value`` descending (NULLs first, as a descending SQL
sort does) with a unique ascending tie-break; each row gets its running
share of the grand total and a class: A while the running share is at most
80 %, B up to 95 %, C after that (and C when the share is undefined).

Two plans:

* ``abc_top`` (only the first k ranks are wanted): the total is one global
  aggregate, the first k rows come from ``TakeOrderedAndProject``, and the
  running sum is a window over those k rows only.
* ``abc_full`` (every rank): a distributed prefix sum. Rows are range
  partitioned on the sort order (the tie-break keeps hot values splittable),
  sorted within partitions and checkpointed so partition ids stay fixed.
  Per-partition counts and sums (one row per partition) give each partition
  its offset; a window inside each partition adds the local running sum. No step moves all rows to one task, and there is no
  self-join. The grand total is a scalar subquery (one value, no join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY_SUM
from ..session import ensure_checkpoint_dir

# Class limits on the running share.
CLASS_A_LIMIT = (4, 5)     # 0.80 as a fraction
CLASS_B_LIMIT = (19, 20)   # 0.95 as a fraction

WIDE = "decimal(30,0)"     # cents * 100: room for totals up to 10^22


def _order(value: str, tie: Sequence[str]) -> list[Column]:
    return [F.col(value).desc_nulls_first()] + [F.col(t).asc_nulls_last() for t in tie]


def _classify(cum: Column, total: Column) -> Column:
    """A / B / C from cum / total compared exactly (no division). A negative
    total flips the inequality, as dividing by it would."""
    def within(num: int, den: int) -> Column:
        return (F.when(total > 0, cum * den <= total * num)
                 .when(total < 0, cum * den >= total * num))
    return (F.when(within(*CLASS_A_LIMIT), F.lit("A"))
             .when(within(*CLASS_B_LIMIT), F.lit("B"))
             .otherwise(F.lit("C")))


def _share(cum: Column, total: Column) -> Column:
    """ROUND(100 * cum / total, 2); NULL when the total is 0 or NULL."""
    cents_cum = (cum * 100).cast(WIDE)
    cents_total = F.nullif(total, F.lit(0)) * 100
    return F.round((cents_cum * 100).cast(WIDE) / cents_total.cast("decimal(24,0)"), 2).cast("decimal(18,2)")


def _finish(ranked: DataFrame, total: Column, out_cols: Sequence[str], value: str) -> DataFrame:
    """``total`` is a scalar subquery: attached once as a column (one
    subquery, run once, no join), then referenced by name."""
    t = F.col("_total")
    return ranked.withColumn("_total", total).select(
        F.col("rank").cast("bigint").alias("rank"), *out_cols,
        F.col(value).cast(MONEY_SUM).alias(value),
        _share(F.col("_cum"), t).alias("cumulative_pct"),
        _classify(F.col("_cum"), t).alias("abc_class"))


def _total(df: DataFrame, value: str) -> Column:
    return df.agg(F.sum(value).cast(MONEY_SUM).alias("_total")).scalar()


def abc_top(df: DataFrame, value: str, tie: Sequence[str], k: int,
            out_cols: Sequence[str], total: Column | None = None) -> DataFrame:
    """First ``k`` ranks of the ABC curve.

    ``total`` (a scalar subquery) may be given when the grand total is
    cheaper to take from the rows before grouping: the sum of the group sums
    is the sum of the rows, which needs no shuffle."""
    top = df.orderBy(*_order(value, tie)).limit(k)
    # k rows at most: a single-partition window over them is bounded.
    w = Window.orderBy(*_order(value, tie))
    ranked = top.select(
        *out_cols, value, *[t for t in tie if t not in out_cols],
        F.row_number().over(w).alias("rank"),
        F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
         .cast(MONEY_SUM).alias("_cum"))
    return _finish(ranked, _total(df, value) if total is None else total, out_cols, value)


def abc_full(df: DataFrame, value: str, tie: Sequence[str], out_cols: Sequence[str],
             partitions: int | None = None) -> DataFrame:
    """Every rank of the ABC curve, as a distributed prefix sum."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    extra = list(dict.fromkeys([*out_cols, *tie]))
    base = df.select(*extra, F.col(value).cast(MONEY_SUM).alias(value))
    order = _order(value, tie)
    # Range bounds are sampled; checkpointing pins every row's partition so
    # the offsets and the local scans below see the same split.
    pinned = (base.repartitionByRange(n, *order).sortWithinPartitions(*order)
                  .withColumn("_pid", F.spark_partition_id())
                  .checkpoint(eager=True))

    stats = pinned.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.sum(value), F.lit(0)).cast(MONEY_SUM).alias("_s"),
        F.count(value).alias("_nn"))
    # One row per partition: a global window over them is bounded by n.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).cast(MONEY_SUM).alias("_off_s"),
        F.coalesce(F.sum("_nn").over(before), F.lit(0)).alias("_off_nn"))

    # Running sums inside each range partition: a window over its pinned rows.
    inside = Window.partitionBy("_pid").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = pinned.select(
        *extra, value, "_pid", F.row_number().over(inside).alias("_lrank"),
        F.coalesce(F.sum(value).over(upto), F.lit(0)).cast(MONEY_SUM).alias("_lcum"),
        F.count(value).over(upto).alias("_lnn"))

    ranked = local.join(F.broadcast(offsets), "_pid").select(
        *extra, value,
        (F.col("_off_n") + F.col("_lrank")).alias("rank"),
        F.when(F.col("_off_nn") + F.col("_lnn") > 0,
               (F.col("_off_s") + F.col("_lcum")).cast(MONEY_SUM)).alias("_cum"))
    # The grand total from the same per-partition rows (NULL if no value).
    total = stats.agg(F.when(F.sum("_nn") > 0, F.sum("_s")).cast(MONEY_SUM).alias("_total")).scalar()
    return _finish(ranked, total, out_cols, value)
