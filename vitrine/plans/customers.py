"""Customers page: Q12-Q16."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (first_label, mean, minus_days, minus_months, money_sum, month_text,
                         not_cancelled)
from ..operators import (activity_summary, bundle, dormant_count, dormant_in_state, frequency_bands, in_period,
                         repeat_count, top_k)
from ..sources.tables import Tables
from .common import asc, desc, resolve, rows, sales_in

# Purchase-count bands (inclusive bounds) and their labels.
PURCHASE_BANDS = (
    (1, 1, "1 compra"),
    (2, 2, "2 compras"),
    (3, 3, "3 compras"),
    (4, 6, "4-6 compras"),
    (7, None, "7+ compras"),
)
NO_STATE = "N/D"


def customer_kpis(t: Tables, as_of: dt.date, period=None, dormant_days: int = 90,
                  null_aware: bool = False) -> DataFrame:
    """Q12: customers in total and new in the period (one scan of the
    customers), repeat buyers in the period and customers dormant for
    ``dormant_days`` (cancelled sales included, period ignored) from one
    aggregation per customer over the sales; where the load step keeps each
    customer's last date, from that and the period's sales alone.

    ``null_aware=True`` reproduces SQL ``NOT IN``: one recent sale without a
    customer makes the dormant count 0."""
    p = resolve(as_of, period)
    cust = t["customers"].agg(
        rows().alias("total_customers"),
        F.count_if(in_period("created_date", p)).cast("bigint").alias("new_customers"))
    if "customer_state" in t:           # kept last dates: only the period's sales are read
        repeat = repeat_count(sales_in(t, p).where(not_cancelled()), "customer_id").withColumnRenamed("repeat", "repeat_customers")
        dormant = dormant_in_state(t["customer_state"], "customer_id", "last_date", minus_days(as_of, dormant_days),
                                   null_aware, "dormant_customers")
        return bundle(cust, repeat, dormant)
    activity = activity_summary(
        t["sales"], "customer_id", "sale_date", minus_days(as_of, dormant_days),
        counted=in_period("sale_date", p) & not_cancelled(), null_aware=null_aware,
        repeat_alias="repeat_customers", dormant_alias="dormant_customers")
    return bundle(cust, activity)


def dormant_customers(t: Tables, as_of: dt.date, dormant_days: int = 90,
                      null_aware: bool = True) -> DataFrame:
    """O12 alone, with the SQL NOT IN rule by default."""
    if "customer_state" in t:
        return dormant_in_state(t["customer_state"], "customer_id", "last_date", minus_days(as_of, dormant_days),
                                null_aware, "dormant_customers")
    return dormant_count(t["sales"], "customer_id", "sale_date", minus_days(as_of, dormant_days),
                         null_aware=null_aware, alias="dormant_customers")


def new_customers_monthly(t: Tables, as_of: dt.date, months: int = 18) -> DataFrame:
    """Q13: new customers per 'YYYY-MM' over the last ``months`` months."""
    c = t["customers"]
    return (c.where(F.col("created_date") >= F.lit(minus_months(as_of, months)))
            .groupBy(month_text("created_date").alias("month"))
            .agg(rows().alias("new_customers"))
            .orderBy("month"))


def customers_by_state(t: Tables, as_of: dt.date, period=None, limit: int = 20) -> DataFrame:
    """Q14: distinct customers and revenue per state, top by revenue."""
    p = resolve(as_of, period)
    g = (sales_in(t, p).where(not_cancelled())
         .groupBy(first_label("state", default=NO_STATE).alias("state"))
         .agg(F.count_distinct("customer_id").cast("bigint").alias("customers"),
              money_sum("total").alias("revenue")))
    return top_k(g, [desc("revenue"), asc("state")], limit)


def purchase_frequency(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q15: customers per purchase-count band (NULL customer is one group),
    bands ordered by their smallest count."""
    p = resolve(as_of, period)
    bands = frequency_bands(sales_in(t, p).where(not_cancelled()), "customer_id",
                            PURCHASE_BANDS, band_col="band", count_col="customers")
    return bands.orderBy("_min_events").select("band", "customers")


def top_customers(t: Tables, as_of: dt.date, period=None, limit: int = 20) -> DataFrame:
    """Q16: per customer name, orders, revenue, mean ticket, last purchase."""
    p = resolve(as_of, period)
    g = (sales_in(t, p).where(not_cancelled()).groupBy("customer_name")
         .agg(rows().alias("orders"), money_sum("total").alias("revenue"),
              mean("total").alias("avg_ticket"), F.max("sale_date").alias("last_purchase")))
    return top_k(g, [desc("revenue"), asc("customer_name")], limit)
