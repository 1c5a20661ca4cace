"""Search page: Q34-Q40.

Click-through rate and position are recomputed from sums (impression
weighted); the stored per-row ctr is never averaged.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import click_rate, minus_months, month_text, weighted_position
from ..operators import bundle, in_period, previous_period, top_k
from ..sources.kept import distinct_keys
from ..sources.tables import Tables
from .common import asc, desc, resolve


def _sum(c: Column | str, pred: Column | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c if pred is None else F.when(pred, c))


def _measures(pred: Column | None = None) -> list[Column]:
    clicks, impr = _sum("clicks", pred), _sum("impressions", pred)
    wpos = _sum(F.col("position") * F.col("impressions"), pred)
    return [clicks.cast("bigint").alias("clicks"), impr.cast("bigint").alias("impressions"),
            click_rate(clicks, impr).alias("ctr"),
            weighted_position(wpos, impr).alias("avg_position")]


def search_kpis(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q34: period totals, CTR, position, distinct queries and pages, plus
    clicks and impressions of the previous period of equal length. One scan
    over both (adjacent) ranges with conditional aggregates; from the kept
    sums and bitmaps of the days where the load step writes them."""
    p = resolve(as_of, period)
    prev = previous_period(p)
    cur, before = in_period("day", p), in_period("day", prev)
    if "search_days" in t:
        return _kpis_of_days(t, p, prev)
    q = t["search_queries"].where(F.col("day").between(F.lit(prev.start), F.lit(p.end)))
    clicks, impr = _sum("clicks", cur), _sum("impressions", cur)
    wpos = _sum(F.col("position") * F.col("impressions"), cur)
    return q.agg(
        F.coalesce(clicks, F.lit(0)).cast("bigint").alias("clicks"),
        F.coalesce(impr, F.lit(0)).cast("bigint").alias("impressions"),
        click_rate(clicks, impr).alias("ctr"),
        weighted_position(wpos, impr).alias("avg_position"),
        F.count_distinct(F.when(cur, F.col("query"))).cast("bigint").alias("total_queries"),
        F.count_distinct(F.when(cur, F.col("page"))).cast("bigint").alias("total_pages"),
        F.coalesce(_sum("clicks", before), F.lit(0)).cast("bigint").alias("clicks_prev"),
        F.coalesce(_sum("impressions", before), F.lit(0)).cast("bigint").alias("impressions_prev"))


def _kpis_of_days(t: Tables, p, prev) -> DataFrame:
    cur, before = in_period("day", p), in_period("day", prev)
    days = t["search_days"].where(F.col("day").between(F.lit(prev.start), F.lit(p.end)))
    clicks, impr, weight = (_sum(c, cur) for c in ("clicks", "impressions", "weight"))
    sums = days.agg(
        F.coalesce(clicks, F.lit(0)).cast("bigint").alias("clicks"), F.coalesce(impr, F.lit(0)).cast("bigint").alias("impressions"),
        click_rate(clicks, impr).alias("ctr"), weighted_position(weight, impr).alias("avg_position"),
        F.coalesce(_sum("clicks", before), F.lit(0)).cast("bigint").alias("clicks_prev"),
        F.coalesce(_sum("impressions", before), F.lit(0)).cast("bigint").alias("impressions_prev"))
    keys = t["search_day_keys"].where(cur)
    out = bundle(sums, distinct_keys(keys, "query").withColumnRenamed("n", "total_queries"),
                 distinct_keys(keys, "page").withColumnRenamed("n", "total_pages"))
    return out.select("clicks", "impressions", "ctr", "avg_position", "total_queries", "total_pages", "clicks_prev", "impressions_prev")


def _in(t: Tables, table: str, p) -> DataFrame:
    return t[table].where(in_period("day", p))


def search_clicks_daily(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q35: clicks and impressions per day."""
    p = resolve(as_of, period)
    if "search_days" in t:
        return _in(t, "search_days", p).select("day", "clicks", "impressions").orderBy("day")
    return (_in(t, "search_queries", p).groupBy("day")
            .agg(_sum("clicks").cast("bigint").alias("clicks"),
                 _sum("impressions").cast("bigint").alias("impressions"))
            .orderBy("day"))


def top_search_queries(t: Tables, as_of: dt.date, period=None, limit: int = 30) -> DataFrame:
    """Q36: top queries by clicks with CTR and position."""
    p = resolve(as_of, period)
    g = _in(t, "search_queries", p).groupBy("query").agg(*_measures())
    return top_k(g, [desc("clicks"), asc("query")], limit)


def top_search_pages(t: Tables, as_of: dt.date, period=None, limit: int = 20) -> DataFrame:
    """Q37: top pages by clicks, from the page table's own totals."""
    p = resolve(as_of, period)
    g = _in(t, "search_pages", p).groupBy("page").agg(*_measures())
    return top_k(g, [desc("clicks"), asc("page")], limit)


def search_by_device(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q38: clicks and impressions per device."""
    p = resolve(as_of, period)
    return (_in(t, "search_queries", p).groupBy("device")
            .agg(_sum("clicks").cast("bigint").alias("clicks"),
                 _sum("impressions").cast("bigint").alias("impressions"))
            .orderBy(desc("clicks"), asc("device")))


def search_position_daily(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q39: impression-weighted position and clicks per day."""
    p = resolve(as_of, period)
    if "search_days" in t:
        return (_in(t, "search_days", p).groupBy("day")
                .agg(weighted_position(_sum("weight"), _sum("impressions")).alias("avg_position"),
                     _sum("clicks").cast("bigint").alias("clicks"))
                .orderBy("day"))
    return (_in(t, "search_queries", p).groupBy("day")
            .agg(weighted_position(_sum(F.col("position") * F.col("impressions")),
                                   _sum("impressions")).alias("avg_position"),
                 _sum("clicks").cast("bigint").alias("clicks"))
            .orderBy("day"))


def search_monthly(t: Tables, as_of: dt.date, months: int = 12) -> DataFrame:
    """Q40: clicks, impressions and distinct queries per 'YYYY-MM' over the
    last ``months`` months."""
    since = F.col("day") >= F.lit(minus_months(as_of, months))
    if "search_days" in t:
        month = month_text("day")
        sums = t["search_days"].where(since).groupBy(month.alias("month")).agg(
            _sum("clicks").cast("bigint").alias("clicks"), _sum("impressions").cast("bigint").alias("impressions"))
        keys = distinct_keys(t["search_day_keys"].where(since), "query", [month])
        return sums.join(keys.select(F.col("_by0").alias("month"), F.col("n").alias("queries")), "month", "left") \
            .withColumn("queries", F.coalesce("queries", F.lit(0)).cast("bigint")).orderBy("month")
    q = t["search_queries"].where(since)
    return (q.groupBy(month_text("day").alias("month"))
            .agg(_sum("clicks").cast("bigint").alias("clicks"),
                 _sum("impressions").cast("bigint").alias("impressions"),
                 F.count_distinct("query").cast("bigint").alias("queries"))
            .orderBy("month"))
