"""Every query under one name, with the fixed test parameters.

Parameters are the dates of FIXTURES.md: sales, stock and payables use
as_of 2001-08-01 and the year 2000; search and subscription data use as_of
2024-01-31 and 2024-01-10..2024-01-20. Never the wall clock.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.period import Period
from ..sources.tables import Tables, from_testdata
from . import customers, finance, freight, ingest, overview, products, sales, search, stock

SALES_AS_OF = dt.date(2001, 8, 1)
SALES_PERIOD = Period(dt.date(2000, 1, 1), dt.date(2000, 12, 31))
SEARCH_AS_OF = dt.date(2024, 1, 31)
SEARCH_PERIOD = Period(dt.date(2024, 1, 10), dt.date(2024, 1, 20))

_SALES = {"as_of": SALES_AS_OF, "period": SALES_PERIOD}
_SALES_DAY = {"as_of": SALES_AS_OF}
_SEARCH = {"as_of": SEARCH_AS_OF, "period": SEARCH_PERIOD}
_SEARCH_DAY = {"as_of": SEARCH_AS_OF}

QUERIES: dict[str, tuple[Callable[..., DataFrame], dict]] = {
    "q01_overview_kpis": (overview.overview_kpis, _SALES),
    "q02_revenue_daily": (overview.revenue_daily, _SALES),
    "q03_orders_by_status": (overview.orders_by_status, _SALES),
    "q04_top_products_overview": (overview.top_products_overview, _SALES),
    "q05_monthly_compare": (overview.monthly_compare, _SALES_DAY),
    "q06_heatmap": (overview.heatmap, _SALES),
    "q07_sales_kpis": (sales.sales_kpis, _SALES),
    "q08_sales_by_channel": (sales.sales_by_channel, _SALES),
    "q09_sales_by_payment": (sales.sales_by_payment, _SALES),
    "q10_sales_monthly": (sales.sales_monthly, _SALES),
    "q11_latest_sales": (sales.latest_sales, _SALES),
    "q12_customer_kpis": (customers.customer_kpis, _SALES),
    "q13_new_customers_monthly": (customers.new_customers_monthly, _SALES_DAY),
    "q14_customers_by_state": (customers.customers_by_state, _SALES),
    "q15_purchase_frequency": (customers.purchase_frequency, _SALES),
    "q16_top_customers": (customers.top_customers, _SALES),
    "q17_product_kpis": (products.product_kpis, _SALES),
    "q18_top_products": (products.top_products, _SALES),
    "q19_product_abc": (products.product_abc, _SALES),
    "q20_stock_kpis": (stock.stock_kpis, _SALES_DAY),
    "q21_top_stock_cost": (stock.top_stock_cost, _SALES_DAY),
    "q22_stock_abc": (stock.stock_abc, _SALES_DAY),
    "q23_dead_stock": (stock.dead_stock_report, _SALES_DAY),
    "q24_freight_kpis": (freight.freight_kpis, _SALES),
    "q25_freight_by_method": (freight.freight_by_method, _SALES),
    "q26_freight_by_state": (freight.freight_by_state, _SALES),
    "q27_open_shipments": (freight.open_shipments, _SALES_DAY),
    "q28_shipment_status": (freight.shipment_status, _SALES_DAY),
    "q29_finance_kpis": (finance.finance_kpis, _SALES),
    "q30_finance_daily": (finance.finance_daily, _SALES),
    "q31_subscription_revenue_monthly": (finance.subscription_revenue_monthly, _SEARCH_DAY),
    "q32_subscriptions_monthly": (finance.subscriptions_monthly, _SEARCH_DAY),
    "q33_payables_by_period_label": (finance.payables_by_period_label, _SALES),
    "q34_search_kpis": (search.search_kpis, _SEARCH),
    "q35_search_clicks_daily": (search.search_clicks_daily, _SEARCH),
    "q36_top_search_queries": (search.top_search_queries, _SEARCH),
    "q37_top_search_pages": (search.top_search_pages, _SEARCH),
    "q38_search_by_device": (search.search_by_device, _SEARCH),
    "q39_search_position_daily": (search.search_position_daily, _SEARCH),
    "q40_search_monthly": (search.search_monthly, _SEARCH_DAY),
    "o10_abc_full_curve": (products.product_abc_full, _SALES),
    "o12_dormant_null_aware": (customers.dormant_customers, {**_SALES_DAY, "null_aware": True}),
    "o12_dormant_no_recent_null": (customers.dormant_customers, {"as_of": dt.date(2001, 9, 15), "null_aware": True}),
    "j1_upsert_queries": (ingest.upsert_queries, _SEARCH_DAY),
    "j2_upsert_pages": (ingest.upsert_pages, _SEARCH_DAY),
    "o02_default_period": (sales.sales_kpis, {"as_of": dt.date(2000, 6, 15), "period": None}),
    "s4_curated_refresh": (ingest.curated_refresh, _SALES_DAY),
    "o01_bad_dates": (ingest.bad_dates, _SALES_DAY),
    "s1_incremental_pull": (ingest.incremental_pull, _SALES_DAY),
    "s5_kept_summaries": (ingest.summaries_after_changes, _SALES_DAY),
    "s2_landing_pages": (ingest.landing_pages, _SEARCH_DAY),
    "j1_sync_files": (ingest.sync_files, {**_SEARCH_DAY, "table": "search_queries"}),
    "j2_sync_files": (ingest.sync_files, {**_SEARCH_DAY, "table": "search_pages"}),
    "j3_sync_windows": (ingest.sync_windows, _SEARCH_DAY),
    "j4_ensure_tables": (ingest.tables_with_keys, _SEARCH_DAY),
    "o20_upsert_into_target": (ingest.upsert_into_target, _SEARCH_DAY),
}

#: Queries that run load or sync jobs when they are built: they write tables of
#: their own and take as long as those jobs do.
JOBS = frozenset({"s1_incremental_pull", "s2_landing_pages", "s4_curated_refresh", "s5_kept_summaries", "o20_upsert_into_target",
                  "j1_sync_files", "j2_sync_files", "j3_sync_windows", "j4_ensure_tables"})


def run(name: str, tables: Tables, **overrides) -> DataFrame:
    fn, params = QUERIES[name]
    return fn(tables, **{**params, **overrides})


def query_callable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """(spark, sf_dir) -> DataFrame over the test views of ``sf_dir``."""
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(name, from_testdata(spark, sf_dir))
    call.__name__ = name
    return call
