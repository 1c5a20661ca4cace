"""Whole queries over tiny hand-made tables (FIXTURES.md §5 edge rows)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from vitrine.operators import Period
from vitrine.plans import run
from vitrine.schemas import CUSTOMERS, PRODUCTS, SALE_ITEMS, SALES, SEARCH_QUERIES, SHIPMENTS
from vitrine.sources import from_frames

AS_OF = dt.date(2024, 3, 1)
P = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
D = Decimal


def _sale(sid, day, status, total, customer=1, name="Ann", state="SP", freight=D("0"),
          discount=D("1"), channel="", marketplace="", pm="pix", pf=""):
    return (sid, str(sid), "", customer, name, day, status, total, total, freight, discount,
            channel, marketplace, pm, pf, "Correios", state, "2024-01-05 10:30:00")


@pytest.fixture(scope="module")
def t(spark):
    sales = [
        _sale(1, "2024-01-05", "Aprovado", D("100.00"), customer=1, name="Ann"),
        _sale(2, "05/01/2024", "Entregue", D("100.00"), customer=2, name="Bob"),   # tie with sale 1
        _sale(3, "2024-01-07", "Cancelado", D("50.00"), customer=1),
        _sale(4, "2024-01-08", None, D("70.00"), customer=None, name="Zed"),        # NULL status
        _sale(5, "2024-02-30", "Aprovado", D("999.00")),                            # impossible date
        _sale(6, "", "Aprovado", D("5.00")),
        _sale(7, "2023-06-01", "Aprovado", D("10.00"), customer=3, name="Cy"),     # old customer
    ]
    items = [
        (1, "A", "widget", D("1"), D("60.00"), D("60.00")),
        (1, "B", "gadget", D("2"), None, D("10.00")),          # NULL line total
        (2, "A", "widget", D("1"), D("40.00"), D("40.00")),
        (2, "C", "nullonly", D("1"), None, D("5.00")),         # a description with only NULLs
        (3, "A", "widget", D("9"), D("900.00"), D("100.00")),  # cancelled sale
        (99, "D", "orphan", D("1"), D("1.00"), D("1.00")),     # no such sale
    ]
    products = [
        ("A", "Widget", "Ativo", 10, D("5.00"), D("2.00")),
        ("B", "Gadget", "Ativo", 3, D("5.00"), D("2.00")),
        ("D", "Dusty", "Ativo", 4, D("5.00"), D("3.00")),
        ("E", "Neg", "Ativo", -2, D("5.00"), D("1.00")),
        ("F", "Nul", "Ativo", None, D("5.00"), None),
        ("G", "Off", "Inativo", 9, D("5.00"), D("1.00")),
    ]
    shipments = [
        ("T1", 1, "Objeto postado", None, 0, "2024-01-09", "2024-01"),
        ("T2", 99, "em transito", "2024-01-08", 0, "2024-01-09", "2024-01"),
        ("T3", 2, None, "2024-01-09", 1, "2024-01-09", "2024-01"),
    ]
    search = [
        (dt.date(2024, 1, 10), "q1", "/a", "BRA", "MOBILE", 3, 0, None, D("2.00"), None),
        (dt.date(2024, 1, 11), "q2", None, "BRA", "DESKTOP", 1, 10, None, D("3.00"), None),
    ]
    spark_ = spark
    return from_frames({
        "sales": spark_.createDataFrame(sales, SALES),
        "sale_items": spark_.createDataFrame(items, SALE_ITEMS),
        "products": spark_.createDataFrame(products, PRODUCTS),
        "shipments": spark_.createDataFrame(shipments, SHIPMENTS),
        "search_queries": spark_.createDataFrame(search, SEARCH_QUERIES),
        "customers": spark_.createDataFrame(
            [(1, "2024-01-02"), (2, "15/01/2024"), (3, ""), (4, "2023-12-31")], CUSTOMERS),
    })


def test_kpis_count_null_status_only_in_rows(t):
    r = run("q07_sales_kpis", t, as_of=AS_OF, period=P).first()
    # in period: sales 1, 2 (dd/mm layout), 3 (cancelled), 4 (NULL status)
    assert (r.orders, r.cancellations) == (2, 1)
    assert r.revenue == D("200.00")
    assert r.pct_cancelled == D("25.0")          # 1 of 4 rows, NULL status in the denominator


def test_top_k_tie_break_and_null_sum_first(t):
    rows = run("q04_top_products_overview", t, as_of=AS_OF, period=P, limit=3).collect()
    assert [r.description for r in rows] == ["gadget", "nullonly", "widget"]  # NULL sums lead, by name
    assert rows[2].revenue == D("100.00")        # cancelled sale's line excluded
    top = run("q16_top_customers", t, as_of=AS_OF, period=P, limit=2).collect()
    assert [r.customer_name for r in top] == ["Ann", "Bob"]                  # equal revenue: by name


def test_abc_with_null_group(t):
    rows = run("q19_product_abc", t, as_of=AS_OF, period=P).orderBy("rank").collect()
    assert [(r.description, r.abc_class) for r in rows][:2] == [("gadget", "C"), ("nullonly", "C")]
    assert rows[2].cumulative_pct == D("100.00") and rows[2].abc_class == "C"


def test_dormant_and_repeat(t):
    r = run("q12_customer_kpis", t, as_of=AS_OF, period=P, dormant_days=90).first()
    assert (r.total_customers, r.new_customers) == (4, 2)
    assert r.repeat_customers == 0      # customer 1 has one live sale in the period
    # cutoff 2023-12-02: customer 3 is dormant; customers 1, 2 are recent
    assert r.dormant_customers == 1
    na = run("o12_dormant_null_aware", t, as_of=AS_OF).first()
    assert na.dormant_customers == 0    # a recent sale without a customer


def test_dead_stock_and_stock_kpis(t):
    rows = run("q23_dead_stock", t, as_of=AS_OF, days=60, limit=None).collect()
    # cutoff 2024-01-01: A and B last sold 2024-01-05, so not dead; D has no live sale at all
    assert [(r.sku, r.last_sale, r.days_idle) for r in rows] == [("D", None, None)]
    k = run("q20_stock_kpis", t, as_of=AS_OF).first()
    assert (k.with_stock, k.zero_stock, k.critical) == (3, 1, 2)   # -2 in no bucket


def test_open_shipments_left_join_and_status(t):
    rows = run("q27_open_shipments", t, as_of=AS_OF).collect()
    assert [r.tracking_code for r in rows] == ["T1", "T2"]          # NULL check date first
    assert rows[1].customer_name is None                             # parcel without a sale
    st = {r.status: r.parcels for r in run("q28_shipment_status", t, as_of=AS_OF).collect()}
    assert st == {"Postado": 1, "Outros": 1}


def test_search_zero_impressions(t):
    rows = {r.query: r for r in run("q36_top_search_queries", t, as_of=AS_OF,
                                    period=Period(dt.date(2024, 1, 10), dt.date(2024, 1, 20))).collect()}
    assert rows["q1"].ctr == D("0.00") and rows["q1"].avg_position == D("0.0")
    assert rows["q2"].ctr == D("10.00") and rows["q2"].avg_position == D("3.0")
    k = run("q34_search_kpis", t, as_of=AS_OF, period=Period(dt.date(2024, 1, 10), dt.date(2024, 1, 20))).first()
    assert (k.total_queries, k.total_pages) == (2, 1)                # NULL page not counted


def test_caller_limit_zero_and_negative(t):
    assert run("q04_top_products_overview", t, as_of=AS_OF, period=P, limit=0).count() == 0
    with pytest.raises(Exception):
        run("q04_top_products_overview", t, as_of=AS_OF, period=P, limit=-1).collect()
