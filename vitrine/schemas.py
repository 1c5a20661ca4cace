"""Explicit schemas of the ten shop and search tables (never inferred).

Text dates stay text here (``*_text``); the table loaders add the parsed
DATE columns listed in ``PARSED_DATES``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I = T.StringType(), T.LongType(), T.IntegerType()
M = T.DecimalType(18, 2)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SALES = _schema(
    ("sale_id", L, False), ("sale_number", S, True), ("marketplace_number", S, True),
    ("customer_id", L, True), ("customer_name", S, True), ("sale_date_text", S, True),
    ("status", S, True), ("total", M, True), ("products_total", M, True),
    ("freight", M, True), ("discount", M, True), ("channel", S, True),
    ("marketplace", S, True), ("payment_method", S, True), ("payment_form", S, True),
    ("ship_method", S, True), ("state", S, True), ("synced_at_text", S, True))

SALE_ITEMS = _schema(
    ("sale_id", L, False), ("sku", S, True), ("description", S, True),
    ("quantity", M, True), ("line_total", M, True), ("unit_price", M, True))

PRODUCTS = _schema(
    ("sku", S, True), ("name", S, True), ("status", S, True), ("stock", I, True),
    ("price", M, True), ("cost", M, True))

CUSTOMERS = _schema(("customer_id", L, False), ("created_text", S, True))

PAYABLES = _schema(
    ("period_label", S, True), ("due_date_text", S, True), ("amount", M, True),
    ("balance", M, True))

SUBSCRIPTION_SALES = _schema(
    ("event_id", L, False), ("confirmed_at_text", S, True), ("net_amount", M, True))

SUBSCRIPTIONS = _schema(
    ("event_id", L, False), ("started_at_text", S, True), ("last_status", S, True))

SHIPMENTS = _schema(
    ("tracking_code", S, True), ("sale_id", L, True), ("status_text", S, True),
    ("last_checked", S, True), ("delivered", I, True), ("due_date", S, True),
    ("ship_form", S, True))

SEARCH_QUERIES = _schema(
    ("day", T.DateType(), False), ("query", S, False), ("page", S, True),
    ("country", S, True), ("device", S, True), ("clicks", I, True),
    ("impressions", I, True), ("ctr", T.DecimalType(6, 4), True),
    ("position", T.DecimalType(6, 2), True), ("synced_at", T.TimestampNTZType(), True))

SEARCH_PAGES = _schema(
    ("day", T.DateType(), False), ("page", S, False), ("clicks", I, True),
    ("impressions", I, True), ("ctr", T.DecimalType(6, 4), True),
    ("position", T.DecimalType(6, 2), True), ("synced_at", T.TimestampNTZType(), True))

TABLES = {
    "sales": SALES, "sale_items": SALE_ITEMS, "products": PRODUCTS,
    "customers": CUSTOMERS, "payables": PAYABLES,
    "subscription_sales": SUBSCRIPTION_SALES, "subscriptions": SUBSCRIPTIONS,
    "shipments": SHIPMENTS, "search_queries": SEARCH_QUERIES,
    "search_pages": SEARCH_PAGES,
}

# table -> (parsed DATE column, text column it is parsed from)
PARSED_DATES = {
    "sales": ("sale_date", "sale_date_text"),
    "customers": ("created_date", "created_text"),
    "payables": ("due_on", "due_date_text"),
    "subscription_sales": ("confirmed_date", "confirmed_at_text"),
    "subscriptions": ("started_date", "started_at_text"),
}

# Upsert keys of the two search tables (the unique constraints).
SEARCH_QUERY_KEYS = ("day", "query", "page", "country", "device")
SEARCH_PAGE_KEYS = ("day", "page")
SEARCH_MEASURES = ("clicks", "impressions", "ctr", "position")

# Landing rows as the search API returns them.
LANDING = _schema(
    ("keys", T.ArrayType(S), True), ("clicks", T.DoubleType(), True),
    ("impressions", T.DoubleType(), True), ("ctr", T.DoubleType(), True),
    ("position", T.DoubleType(), True))


def curated_schema(name: str) -> T.StructType:
    """Explicit schema of a curated table: the table's own schema plus its
    parsed DATE column, the month partition of sales and order lines, the sale's
    date and status carried by each order line, and the sale's customer, state
    and total carried by each parcel."""
    fields = list(TABLES[name].fields)
    if name in PARSED_DATES:
        fields.append(T.StructField(PARSED_DATES[name][0], T.DateType()))
    if name == "sale_items":
        fields += [T.StructField("sale_date", T.DateType()), T.StructField("sale_status", S)]
    if name == "shipments":
        fields += [T.StructField("sale_customer_name", S), T.StructField("sale_state", S), T.StructField("sale_total", M)]
    if name in ("sales", "sale_items"):
        fields.append(T.StructField("sale_month", T.DateType()))
    return T.StructType(fields)
