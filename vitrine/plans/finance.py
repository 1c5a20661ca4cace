"""Finance page: Q29-Q33."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_where, first_label, money_sum, month_start, not_cancelled
from ..functions.columns import MONEY_SUM
from ..functions.dates import first_of_month
from ..operators import bundle, in_period, top_k
from ..sources.tables import Tables
from .common import asc, dated_between, desc, resolve, rows, sales_in
from .customers import NO_STATE

ACTIVE_SUB, CANCELLED_SUB = "active", "canceled"   # fixed values: subscription states


def finance_kpis(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q29: gross, discounts and net revenue; payables due in the period,
    overdue and due in the next 30 days (both ends included, so 31 days);
    active subscribers; month-to-date subscription revenue."""
    p = resolve(as_of, period)
    nc = not_cancelled()
    sales = sales_in(t, p).agg(
        money_sum("total", nc, zero_if_empty=True).alias("gross_revenue"),
        money_sum("discount", nc, zero_if_empty=True).alias("discounts"),
        money_sum(F.col("total") - F.col("discount"), nc, zero_if_empty=True).alias("net_revenue"))
    due, open_ = F.col("due_on"), F.col("balance") > 0
    today = F.lit(as_of)
    payables = t["payables"].agg(
        money_sum("amount", in_period(due, p), zero_if_empty=True).alias("payable_in_period"),
        money_sum("amount", (due < today) & open_, zero_if_empty=True).alias("overdue"),
        money_sum("amount", due.between(today, F.lit(as_of + dt.timedelta(days=30))) & open_,
                  zero_if_empty=True).alias("due_next_30d"))
    subs = t["subscriptions"].where(F.col("last_status") == ACTIVE_SUB) \
        .agg(rows().alias("active_subscribers"))
    month_rev = (t["subscription_sales"]
                 .where(F.col("confirmed_date") >= F.lit(first_of_month(as_of)))
                 .agg(money_sum("net_amount", zero_if_empty=True).alias("month_revenue")))
    return bundle(sales, payables, subs, month_rev)


def finance_daily(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q30: per day, not-cancelled revenue and discounts."""
    p = resolve(as_of, period)
    nc = not_cancelled()
    if "sales_days" in t:
        return dated_between(t["sales_days"], p.start, p.end).select(
            F.col("sale_date").alias("day"), *(F.coalesce(c, F.lit(0)).cast(MONEY_SUM).alias(c) for c in ("revenue", "discount"))) \
            .orderBy("day")
    return (sales_in(t, p).groupBy(F.col("sale_date").alias("day"))
            .agg(money_sum("total", nc, zero_if_empty=True).alias("revenue"),
                 money_sum("discount", nc, zero_if_empty=True).alias("discount"))
            .orderBy("day"))


def _has_text(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def subscription_revenue_monthly(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """Q31: subscription sales and net revenue per month start."""
    return (t["subscription_sales"].where(_has_text("confirmed_at_text"))
            .groupBy(month_start("confirmed_date").alias("month"))
            .agg(rows().alias("sales"), money_sum("net_amount", zero_if_empty=True).alias("revenue"))
            .orderBy(asc("month")))


def subscriptions_monthly(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """Q32: per start month, subscriptions now active and now cancelled."""
    st = F.col("last_status")
    return (t["subscriptions"].where(_has_text("started_at_text"))
            .groupBy(month_start("started_date").alias("month"))
            .agg(count_where(st == ACTIVE_SUB).alias("active"),
                 count_where(st == CANCELLED_SUB).alias("cancelled"))
            .orderBy(asc("month")))


def payables_by_period_label(t: Tables, as_of: dt.date, period=None, limit: int = 15) -> DataFrame:
    """Q33: payables due in the period, per accounting period label."""
    p = resolve(as_of, period)
    g = (t["payables"].where(in_period("due_on", p))
         .groupBy(first_label("period_label", default=NO_STATE).alias("period_label"))
         .agg(money_sum("amount").alias("total"), rows().alias("payables")))
    return top_k(g, [desc("total"), asc("period_label")], limit)
