"""Sales page: Q07-Q11."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (cancelled, count_where, first_label, mean, money_sum, month_text,
                         not_cancelled, safe_pct)
from ..operators import top_k
from ..sources.tables import Tables
from .common import asc, dated_between, desc, resolve, rows, sales_in

# Default labels of empty channels and payment methods.
DIRECT = "Direto"
NOT_GIVEN = "Não informado"


def sales_kpis(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q07: one multi-aggregate over one scan of the period's sales. The
    cancelled share divides by every row, NULL status included."""
    p = resolve(as_of, period)
    nc, c = not_cancelled(), cancelled()
    return sales_in(t, p).agg(
        count_where(nc).alias("orders"),
        money_sum("total", nc, zero_if_empty=True).alias("revenue"),
        money_sum("products_total", nc, zero_if_empty=True).alias("products_total"),
        money_sum("freight", nc, zero_if_empty=True).alias("freight_total"),
        money_sum("discount", nc, zero_if_empty=True).alias("discount_total"),
        F.coalesce(mean("total", nc), F.lit(0.0)).alias("avg_ticket"),
        count_where(c).alias("cancellations"),
        safe_pct(F.count_if(c), F.count(F.lit(1)), 1).alias("pct_cancelled"))


def sales_by_channel(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q08: not-cancelled orders and revenue per sales channel; the channel
    falls back to the marketplace name, then to 'Direto'."""
    p = resolve(as_of, period)
    return (sales_in(t, p).where(not_cancelled())
            .groupBy(first_label("channel", "marketplace", default=DIRECT).alias("channel"))
            .agg(rows().alias("orders"), money_sum("total").alias("revenue"))
            .orderBy(desc("revenue"), asc("channel")))


def sales_by_payment(t: Tables, as_of: dt.date, period=None, limit: int = 10) -> DataFrame:
    """Q09: top payment labels by revenue."""
    p = resolve(as_of, period)
    g = (sales_in(t, p).where(not_cancelled())
         .groupBy(first_label("payment_method", "payment_form", default=NOT_GIVEN).alias("payment"))
         .agg(rows().alias("orders"), money_sum("total").alias("revenue")))
    return top_k(g, [desc("revenue"), asc("payment")], limit)


def sales_monthly(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q10: 'YYYY-MM' -> not-cancelled orders and revenue."""
    p = resolve(as_of, period)
    nc = not_cancelled()
    if "sales_days" in t:
        return (dated_between(t["sales_days"], p.start, p.end).groupBy(month_text("sale_date").alias("month"))
                .agg(F.sum("orders").alias("orders"), money_sum("revenue", zero_if_empty=True).alias("revenue"))
                .orderBy("month"))
    return (sales_in(t, p).groupBy(month_text("sale_date").alias("month"))
            .agg(count_where(nc).alias("orders"),
                 money_sum("total", nc, zero_if_empty=True).alias("revenue"))
            .orderBy("month"))


def latest_sales(t: Tables, as_of: dt.date, period=None, limit: int = 50) -> DataFrame:
    """Q11: newest sales of the period, sale id as the tie-break. The
    payment label falls back to the payment form without a default."""
    p = resolve(as_of, period)
    listing = sales_in(t, p).select(
        F.col("sale_date").alias("day"), "sale_number", "marketplace_number",
        "customer_name", "status", "total", "ship_method",
        F.coalesce(F.nullif(F.col("payment_method"), F.lit("")), F.col("payment_form")).alias("payment"),
        "sale_id")
    return top_k(listing, [desc("day"), desc("sale_id")], limit).drop("sale_id")
