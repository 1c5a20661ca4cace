"""Products page: Q17-Q19 and the full ABC curve."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mean, money_sum
from ..operators import abc_full, abc_top, top_k
from ..sources.tables import Tables
from .common import asc, desc, items_of_live_sales, resolve


def product_kpis(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q17: units, distinct skus, revenue and the unweighted mean unit price
    over lines of not-cancelled sales. NULLs (not zeros) when empty."""
    p = resolve(as_of, period)
    return items_of_live_sales(t, p).agg(
        money_sum("quantity").alias("units"),
        F.count_distinct("sku").cast("bigint").alias("skus"),
        money_sum("line_total").alias("revenue"),
        mean("unit_price").alias("avg_unit_price"))


def top_products(t: Tables, as_of: dt.date, period=None, limit: int = 20) -> DataFrame:
    """Q18: per (description, sku): quantity, revenue, mean unit price."""
    p = resolve(as_of, period)
    g = items_of_live_sales(t, p).groupBy("description", "sku").agg(
        money_sum("quantity").alias("quantity"),
        money_sum("line_total").alias("revenue"),
        mean("unit_price").alias("avg_price"))
    return top_k(g, [desc("revenue"), asc("description"), asc("sku")], limit)


def _revenue_by(t: Tables, period, key: str) -> DataFrame:
    return items_of_live_sales(t, period).groupBy(key).agg(money_sum("line_total").alias("revenue"))


def product_abc(t: Tables, as_of: dt.date, period=None, ranks: int = 100) -> DataFrame:
    """Q19: ABC classes of revenue per description, first ``ranks`` ranks."""
    p = resolve(as_of, period)
    # the total sums the grouped rows, so both share one scan (reused exchange)
    return abc_top(_revenue_by(t, p, "description"), "revenue", ["description"], ranks, ["description"])


def product_abc_full(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """O10 over revenue per sku, every rank (distributed prefix sum)."""
    p = resolve(as_of, period)
    return abc_full(_revenue_by(t, p, "sku"), "revenue", ["sku"], ["sku"])
