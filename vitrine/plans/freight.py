"""Freight and parcels page: Q24-Q28."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, count_where, first_label, mean, money_sum, not_cancelled, safe_pct
from ..operators import top_k
from ..sources.tables import Tables
from .common import asc, desc, resolve, rows, sales_in
from .customers import NO_STATE
from .sales import NOT_GIVEN

# Parcel status rules, tried in order (ILIKE patterns -> label).
SHIPMENT_RULES = (
    (("%entregue%",), "Entregue"),
    (("%saiu para%", "%saiu p/%"), "Saiu p/ entrega"),
    (("%em trânsito%", "%transferência%"), "Em trânsito"),
    (("%postado%",), "Postado"),
)
OTHER = "Outros"


def freight_kpis(t: Tables, as_of: dt.date, period=None) -> DataFrame:
    """Q24: freight measures over not-cancelled sales of the period."""
    p = resolve(as_of, period)
    nc = not_cancelled()
    fr = F.col("freight")
    free = (fr == 0) & nc
    return sales_in(t, p).agg(
        count_where(nc).alias("orders"),
        F.coalesce(mean("freight", (fr > 0) & nc), F.lit(0.0)).alias("avg_freight"),
        money_sum("freight", nc, zero_if_empty=True).alias("freight_total"),
        count_where(free).alias("free_shipping"),
        safe_pct(F.count_if(free), F.count_if(nc), 1).alias("pct_free_shipping"))


def freight_by_method(t: Tables, as_of: dt.date, period=None, limit: int = 15) -> DataFrame:
    """Q25: orders, mean freight (zeros included) and total per method."""
    p = resolve(as_of, period)
    g = (sales_in(t, p).where(not_cancelled())
         .groupBy(first_label("ship_method", default=NOT_GIVEN).alias("ship_method"))
         .agg(rows().alias("orders"), mean("freight").alias("avg_freight"),
              money_sum("freight").alias("freight_total")))
    return top_k(g, [desc("orders"), asc("ship_method")], limit)


def freight_by_state(t: Tables, as_of: dt.date, period=None, limit: int = 27) -> DataFrame:
    """Q26: paid-freight orders and mean freight per state, by mean."""
    p = resolve(as_of, period)
    g = (sales_in(t, p).where(not_cancelled() & (F.col("freight") > 0))
         .groupBy(first_label("state", default=NO_STATE).alias("state"))
         .agg(rows().alias("orders"), mean("freight").alias("avg_freight")))
    return top_k(g, [desc("avg_freight"), asc("state")], limit)


def open_shipments(t: Tables, as_of: dt.date | None = None, limit: int | None = 100) -> DataFrame:
    """Q27: undelivered parcels, latest check first, with their sale.

    The left join keeps every parcel, and each parcel yields at least one
    joined row, so the first ``limit`` joined rows all come from the first
    ``limit`` parcels: those are picked first (TakeOrderedAndProject). The
    sales are semi-joined to their ids, which Spark broadcasts if their
    measured size allows, and only then joined: one lazy plan at any limit.
    Curated parcels carry their sale's columns, so no sale is read."""
    order = [desc("last_checked"), asc("tracking_code")]
    if "sale_total" in t["shipments"].columns:      # curated parcels carry their sale's columns
        parcels = t["shipments"].where(F.col("delivered") == 0).select(
            "tracking_code", "status_text", "last_checked", "due_date", "ship_form", F.col("sale_customer_name").alias("customer_name"),
            F.col("sale_state").alias("state"), F.col("sale_total").alias("total"))
        return top_k(parcels, order + [asc("customer_name"), asc("state"), asc("total")], limit)
    parcels = top_k(t["shipments"].where(F.col("delivered") == 0)
                    .select("tracking_code", "status_text", "last_checked", "due_date",
                            "ship_form", "sale_id"), order + [asc("sale_id")], limit)
    sales = (t["sales"].select("sale_id", "customer_name", "state", "total")
             .join(parcels.select("sale_id"), "sale_id", "left_semi"))
    joined = parcels.join(sales, "sale_id", "left").drop("sale_id")
    return top_k(joined, order + [asc("customer_name"), asc("state"), asc("total")], limit)


def shipment_status(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """Q28: undelivered parcels per status class (first matching rule)."""
    return (t["shipments"].where(F.col("delivered") == 0)
            .groupBy(classify("status_text", SHIPMENT_RULES, OTHER).alias("status"))
            .agg(rows().alias("parcels"))
            .orderBy(desc("parcels"), asc("status")))
