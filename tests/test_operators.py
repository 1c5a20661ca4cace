"""Operators against brute force on generated data (fixed seeds)."""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vitrine.operators import abc_full, abc_top, dormant_count, frequency_bands, repeat_count
from vitrine.plans import SALES_AS_OF, SALES_PERIOD, run
from vitrine.plans.customers import PURCHASE_BANDS
from vitrine.sources import from_testdata


# ------------------------------------------------------------ ABC

def brute_abc(rows):
    """rows: [(key, value or None)] -> {key: (rank, cum_pct, class)}."""
    order = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    vals = [v for _, v in rows if v is not None]
    total = sum(vals) if vals else None
    out, cum, seen = {}, Decimal(0), 0
    for rank, (k, v) in enumerate(order, 1):
        if v is not None:
            cum += v
            seen += 1
        c = cum if seen else None
        if c is None or total is None or total == 0:
            pct, cls = None, "C"
        else:
            pct = (Decimal(100) * c / total).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
            share = c / total
            cls = "A" if share <= Decimal("0.8") else "B" if share <= Decimal("0.95") else "C"
        out[k] = (rank, pct, cls)
    return out


def _gen(seed, n, hot=False, negative=False, nulls=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if nulls and rnd.random() < 0.05:
            v = None
        elif hot and rnd.random() < 0.34:
            v = Decimal("42.00")                       # one value holds a third of the rows
        else:
            v = Decimal(rnd.randint(-5000 if negative else 0, 100000)) / 100
        rows.append((f"k{i:05d}", v))
    return rows


def _check(spark, rows, full: bool, k=None, partitions=5):
    df = spark.createDataFrame(rows, "key string, value decimal(38,2)")
    if full:
        got = abc_full(df, "value", ["key"], ["key"], partitions=partitions)
    else:
        got = abc_top(df, "value", ["key"], k, ["key"])
    want = brute_abc(rows)
    res = {r.key: (r.rank, r.cumulative_pct, r.abc_class) for r in got.collect()}
    if k is not None:
        want = {key: v for key, v in want.items() if v[0] <= k}
    assert res == want


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_abc_full_matches_brute_force(spark, seed, hot):
    _check(spark, _gen(seed, 700, hot=hot), full=True)


def test_abc_top_matches_brute_force(spark):
    _check(spark, _gen(3, 400), full=False, k=50)


def test_abc_negative_total_and_zero_total(spark):
    neg = [("a", Decimal("-10.00")), ("b", Decimal("-5.00")), ("c", Decimal("2.00"))]
    _check(spark, neg, full=True, partitions=2)
    _check(spark, neg, full=False, k=3)
    zero = [("a", Decimal("5.00")), ("b", Decimal("-5.00"))]
    _check(spark, zero, full=True, partitions=2)


def test_abc_null_group_first(spark):
    rows = [("a", None), ("b", Decimal("1.00")), ("c", Decimal("3.00"))]
    df = spark.createDataFrame(rows, "key string, value decimal(38,2)")
    first = abc_top(df, "value", ["key"], 3, ["key"]).orderBy("rank").first()
    assert (first.key, first.rank, first.cumulative_pct, first.abc_class) == ("a", 1, None, "C")


def test_abc_full_plan_has_no_nested_loop_over_rows(spark):
    df = spark.createDataFrame(_gen(4, 100), "key string, value decimal(38,2)")
    plan = abc_full(df, "value", ["key"], ["key"], partitions=3)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan     # the total is a scalar subquery
    assert "MapInPandas" not in plan and "Python" not in plan


# ------------------------------------------------------------ O11-O13

def _sales_rows():
    d = dt.date
    return [
        (1, d(2024, 1, 1)), (1, d(2024, 3, 1)),          # active recently
        (2, d(2023, 1, 1)), (2, d(2023, 6, 1)),          # dormant
        (3, d(2023, 2, 1)),                              # dormant
        (4, None),                                       # no dated row
        (None, d(2023, 1, 5)),                           # old row, no customer
    ]


def test_dormant_and_null_aware(spark):
    df = spark.createDataFrame(_sales_rows(), "cid long, day date")
    cut = dt.date(2024, 1, 1)
    assert dormant_count(df, "cid", "day", cut).first()[0] == 2
    assert dormant_count(df, "cid", "day", cut, null_aware=True).first()[0] == 2
    recent_null = spark.createDataFrame(_sales_rows() + [(None, dt.date(2024, 2, 1))], "cid long, day date")
    assert dormant_count(recent_null, "cid", "day", cut).first()[0] == 2
    assert dormant_count(recent_null, "cid", "day", cut, null_aware=True).first()[0] == 0


def test_repeat_and_bands(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([None] + list(range(60))),) for _ in range(500)]
    df = spark.createDataFrame(rows, "cid long")
    counts: dict = {}
    for (c,) in rows:
        counts[c] = counts.get(c, 0) + 1
    assert repeat_count(df, "cid").first()[0] == sum(1 for n in counts.values() if n > 1)
    want: dict = {}
    for n in counts.values():
        label = next(t for lo, hi, t in PURCHASE_BANDS if n >= lo and (hi is None or n <= hi))
        want[label] = want.get(label, 0) + 1
    got = {r.band: r.entities for r in frequency_bands(df, "cid", PURCHASE_BANDS).collect()}
    assert got == want


# ------------------------------------------------------------ O14, O16 equivalences

def test_dead_stock_equals_fan_out_form(spark):
    t = from_testdata(spark, SF_SMALL)
    for name in ("products", "sale_items", "sales"):
        t[name].createOrReplaceTempView(f"t_{name}")
    fan_out = spark.sql("""
        SELECT p.name, p.sku, p.stock, p.cost, MAX(v.sale_date) AS last_sale
        FROM t_products p
        LEFT JOIN t_sale_items vi ON vi.sku = p.sku
        LEFT JOIN t_sales v ON v.sale_id = vi.sale_id AND v.status NOT IN ('Cancelado','Cancelada')
        WHERE p.status = 'Ativo' AND p.stock > 0
        GROUP BY p.name, p.sku, p.stock, p.cost
        HAVING MAX(v.sale_date) < DATE '2001-06-02' OR MAX(v.sale_date) IS NULL""")
    ours = run("q23_dead_stock", t, limit=None).select("name", "sku", "stock", "cost", "last_sale")
    assert sorted(map(tuple, fan_out.collect())) == sorted(map(tuple, ours.collect()))
    assert fan_out.count() > 0


def test_search_kpis_one_pass_equals_two_passes(spark):
    t = from_testdata(spark, SF_SMALL)
    one = run("q34_search_kpis", t).first()
    from vitrine.plans import SEARCH_PERIOD
    from vitrine.operators import previous_period
    q = t["search_queries"]
    prev = previous_period(SEARCH_PERIOD)
    cur = q.where(F.col("day").between(SEARCH_PERIOD.start, SEARCH_PERIOD.end)) \
        .agg(F.sum("clicks"), F.sum("impressions"), F.countDistinct("query")).first()
    before = q.where(F.col("day").between(prev.start, prev.end)) \
        .agg(F.coalesce(F.sum("clicks"), F.lit(0)), F.coalesce(F.sum("impressions"), F.lit(0))).first()
    assert (one.clicks, one.impressions, one.total_queries) == tuple(cur)
    assert (one.clicks_prev, one.impressions_prev) == tuple(before)


def test_empty_period(spark):
    t = from_testdata(spark, SF_SMALL)
    empty = (dt.date(2000, 12, 31), dt.date(2000, 1, 1))     # from > to
    kpis = run("q07_sales_kpis", t, period=empty).first()
    assert kpis.orders == 0 and kpis.revenue == 0 and kpis.pct_cancelled is None
    assert run("q02_revenue_daily", t, period=empty).count() == 0
    prod = run("q17_product_kpis", t, period=empty).first()
    assert prod.units is None and prod.skus == 0


def test_registered_defaults_are_fixed_dates():
    assert SALES_AS_OF == dt.date(2001, 8, 1)
    assert SALES_PERIOD.days == 366


def test_hot_value_spreads_over_range_partitions(spark):
    """The prefix sum range-partitions on (value desc, unique key): a value
    holding a third of the rows still spreads over several partitions."""
    from pyspark.sql.functions import spark_partition_id
    from vitrine.operators.cumulative import _order
    rows = _gen(9, 3000, hot=True, nulls=False)
    df = spark.createDataFrame(rows, "key string, value decimal(38,2)")
    sizes = [r[1] for r in df.repartitionByRange(8, *_order("value", ["key"]))
             .groupBy(spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000
    assert max(sizes) < 0.25 * 3000          # no task holds the hot third


def test_full_curve_share_rises_to_100(spark):
    """SURVEY §5: with non-negative values the running share never falls and
    the last rank is at 100 %; classes run A, then B, then C."""
    t = from_testdata(spark, SF_SMALL)
    rows = run("o10_abc_full_curve", t).orderBy("rank").collect()
    shares = [r.cumulative_pct for r in rows]
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert all(a <= b for a, b in zip(shares, shares[1:]))
    assert shares[-1] == Decimal("100.00")
    classes = "".join(r.abc_class for r in rows)
    assert classes == "".join(sorted(classes))          # A... B... C...


def test_abc_of_totals_beyond_ten_to_sixteen(spark):
    big = [("a", Decimal("15000000000000000.00")), ("b", Decimal("8000000000000000.00"))]
    df = spark.createDataFrame(big, "key string, value decimal(38,2)")
    for out in (abc_top(df, "value", ["key"], 2, ["key"]), abc_full(df, "value", ["key"], ["key"], partitions=2)):
        assert [(r.key, r.cumulative_pct) for r in out.orderBy("rank").collect()] == \
            [("a", Decimal("65.22")), ("b", Decimal("100.00"))]
