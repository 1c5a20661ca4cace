"""Overview page: Q01-Q06."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (cancelled, count_where, mean, minus_years, money_sum, not_cancelled,
                         parse_timestamp, weekday)
from ..functions.columns import MONEY_SUM
from ..operators import bundle, in_period, top_k
from ..sources.tables import Tables
from .common import asc, dated_between, desc, items_of_live_sales, resolve, rows, sales_between, sales_in


def overview_kpis(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q01: order count, revenue, mean ticket, cancellations; new customers;
    active subscribers. Three one-row aggregates merged into one record."""
    p = resolve(as_of, period)
    nc = not_cancelled()
    sales = sales_in(t, p).agg(
        count_where(nc).alias("orders"),
        money_sum("total", nc, zero_if_empty=True).alias("revenue"),
        F.coalesce(mean("total", nc), F.lit(0.0)).alias("avg_ticket"),
        count_where(cancelled()).alias("cancellations"))
    new = t["customers"].where(in_period("created_date", p)).agg(rows().alias("new_customers"))
    subs = t["subscriptions"].where(F.col("last_status") == "active") \
        .agg(rows().alias("active_subscribers"))
    return bundle(sales, new, subs)


def _zero(c: str):
    return F.coalesce(c, F.lit(0)).cast(MONEY_SUM).alias(c)


def revenue_daily(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q02: per day, not-cancelled orders and revenue (0 on days with only
    cancellations)."""
    p = resolve(as_of, period)
    nc = not_cancelled()
    if "sales_days" in t:
        return dated_between(t["sales_days"], p.start, p.end).select(
            F.col("sale_date").alias("day"), "orders", _zero("revenue")).orderBy("day")
    return (sales_in(t, p).groupBy(F.col("sale_date").alias("day"))
            .agg(count_where(nc).alias("orders"),
                 money_sum("total", nc, zero_if_empty=True).alias("revenue"))
            .orderBy("day"))


def orders_by_status(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q03: orders per status, NULL status included, most frequent first."""
    p = resolve(as_of, period)
    return (sales_in(t, p).groupBy("status").agg(rows().alias("orders"))
            .orderBy(desc("orders"), asc("status")))


def top_products_overview(t: Tables, as_of: dt.date, period=None, limit: int = 10) -> DataFrame:
    """Q04: top products by revenue over not-cancelled sales."""
    p = resolve(as_of, period)
    g = items_of_live_sales(t, p).groupBy("description").agg(
        money_sum("quantity").alias("quantity"),
        money_sum("line_total").alias("revenue"))
    return top_k(g, [desc("revenue"), asc("description")], limit)


def monthly_compare(t: Tables, as_of: dt.date, years: int = 2) -> DataFrame:
    """Q05: revenue and orders per calendar month over the last ``years``
    years (no upper bound)."""
    nc = not_cancelled()
    d = F.col("sale_date")
    if "sales_days" in t:
        return (dated_between(t["sales_days"], minus_years(as_of, years))
                .groupBy(F.year(d).alias("year"), F.month(d).alias("month"))
                .agg(money_sum("revenue", zero_if_empty=True).alias("revenue"), F.sum("orders").alias("orders"))
                .orderBy("year", "month"))
    return (sales_between(t, minus_years(as_of, years))
            .groupBy(F.year(d).alias("year"), F.month(d).alias("month"))
            .agg(money_sum("total", nc, zero_if_empty=True).alias("revenue"),
                 count_where(nc).alias("orders"))
            .orderBy("year", "month"))


def heatmap(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q06: orders per (weekday of the sale, hour of the sync stamp),
    cancelled included. The two clocks differ on purpose: the sale date has
    no time of day."""
    p = resolve(as_of, period)
    return (sales_in(t, p)
            .groupBy(weekday("sale_date").alias("weekday"),
                     F.hour(parse_timestamp("synced_at_text")).alias("hour"))
            .agg(rows().alias("orders"))
            .orderBy(asc("weekday"), asc("hour")))
