"""Dead stock.

Products in stock whose last qualifying sale is older than a cutoff, or
that never sold. The textbook form left-joins products to every order line
and every sale of all time, then groups. Whether a product is idle depends
only on the sales since the cutoff, so an anti join against those decides
it; last sale dates are looked up afterwards, for the products reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_sold_since(products: DataFrame, recent: DataFrame, key: str) -> DataFrame:
    """Products whose key is in no recent sale. ``recent`` holds the sales
    since the cutoff only; its keys are made distinct before the anti join,
    so a hot key moves as one row per task. A NULL key was never sold."""
    return products.join(recent.select(key).distinct(), key, "left_anti")


def last_sale_of(wanted: DataFrame, sales: DataFrame, key: str, day: str) -> DataFrame:
    """MAX(sale date) of the wanted keys."""
    return (sales.join(wanted.select(key).distinct(), key, "left_semi")
                 .groupBy(key).agg(F.max(day).alias("last_sale")))
