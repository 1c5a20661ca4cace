"""Stock page: Q20-Q23."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_where, minus_days, money_sum, not_cancelled
from ..functions.columns import MONEY_SUM
from ..operators import abc_top, last_sale_of, not_sold_since, top_k
from ..sources.tables import Tables
from .common import asc, dated_between, desc

ACTIVE = "Ativo"   # fixed value: status text of an active product


def _active(t: Tables) -> DataFrame:
    return t["products"].where(F.col("status") == ACTIVE)


def _stocked_with_cost(t: Tables) -> DataFrame:
    return _active(t).where((F.col("stock") > 0) & (F.col("cost") > 0))


def stock_kpis(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """Q20: stock buckets and stock values over active products. Negative
    stock falls in no bucket."""
    st, cost = F.col("stock"), F.col("cost")
    return _active(t).agg(
        count_where(st > 0).alias("with_stock"),
        count_where((st == 0) | st.isNull()).alias("zero_stock"),
        count_where((st > 0) & (st <= 5)).alias("critical"),
        money_sum(st * F.col("price"), st > 0, zero_if_empty=True).alias("stock_sale_value"),
        money_sum(st * cost, (st > 0) & (cost > 0), zero_if_empty=True).alias("stock_cost_value"))


def _cost_total() -> Column:
    return F.coalesce(F.col("stock") * F.col("cost"), F.lit(0)).cast(MONEY_SUM)


def top_stock_cost(t: Tables, as_of: dt.date | None = None, limit: int = 20) -> DataFrame:
    """Q21: products tying up the most stock cost."""
    rows = _stocked_with_cost(t).select(
        "name", "sku", "stock", "cost", "price",
        _cost_total().alias("cost_total"),
        F.coalesce(F.col("stock") * F.col("price"), F.lit(0)).cast(MONEY_SUM).alias("sale_value"))
    return top_k(rows, [desc("cost_total"), asc("sku")], limit)


def stock_abc(t: Tables, as_of: dt.date | None = None, ranks: int = 80) -> DataFrame:
    """Q22: ABC classes of stock cost per product row, first ``ranks``."""
    rows = _stocked_with_cost(t).select("name", "sku", _cost_total().alias("cost_total"))
    return abc_top(rows, "cost_total", ["sku"], ranks, ["name"])


def _live_lines(t: Tables, since: dt.date | None = None) -> DataFrame:
    """(sku, sale_date) of dated lines of not-cancelled sales, from ``since`` on."""
    items = t["sale_items"]
    if "sale_status" in items.columns:      # curated lines carry their sale
        dated = items if since is None else dated_between(items, since)
        rows = dated.where(not_cancelled("sale_status") & F.col("sale_date").isNotNull())
    else:
        sales = t["sales"] if since is None else dated_between(t["sales"], since)
        rows = items.join(sales.where(not_cancelled() & F.col("sale_date").isNotNull())
                          .select("sale_id", "sale_date"), "sale_id")
    return rows.where(F.col("sku").isNotNull()).select("sku", "sale_date")


def dead_stock_report(t: Tables, as_of: dt.date, days: int = 60, limit: int | None = 30) -> DataFrame:
    """Q23: active products in stock without a not-cancelled sale in the
    last ``days`` days (or never sold), by idle cost; products equal in name,
    sku, stock and cost are one row.

    Neither the condition nor the order needs the history: products without a
    sku sold since the cutoff (a month-pruned scan) are ranked first, and only
    the skus of the first ``limit`` get their last sale date. Where the load
    step keeps each sku's last live sale, no line is read at all."""
    cutoff = minus_days(as_of, days)
    products = _active(t).where(F.col("stock") > 0).select("name", "sku", "stock", "cost").distinct() \
        .withColumn("idle_cost", F.coalesce(F.col("stock") * F.col("cost"), F.lit(0)).cast(MONEY_SUM))
    order = [desc("idle_cost"), asc("sku"), asc("name"), asc("stock"), asc("cost")]
    if "sku_state" in t:
        sold = t["sku_state"].select("sku", F.col("last_date").alias("last_sale"))
        found = products.join(sold, "sku", "left").where(F.col("last_sale").isNull() | (F.col("last_sale") < F.lit(cutoff)))
    else:
        top = top_k(not_sold_since(products, _live_lines(t, cutoff).select("sku"), "sku"), order, limit)
        found = top.join(last_sale_of(top.select("sku"), _live_lines(t), "sku", "sale_date"), "sku", "left")
    report = found.select(
        "name", "sku", "stock", "cost", "idle_cost", "last_sale",
        F.datediff(F.lit(as_of), F.col("last_sale")).alias("days_idle"))
    return top_k(report, order, limit)
