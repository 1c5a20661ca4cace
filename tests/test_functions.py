"""Column helpers on hand-made edge rows (FIXTURES.md §5)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from vitrine.functions import (classify, click_rate, first_label, minus_months, not_cancelled,
                               parse_date, safe_pct, weekday, weighted_position)
from vitrine.operators import Period, default_period, previous_period, sync_window
from vitrine.plans.freight import OTHER, SHIPMENT_RULES


def _one_col(spark, values, name="x", typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {typ}")


def test_parse_date_layouts(spark):
    good = {
        "2024-02-29": dt.date(2024, 2, 29),
        "2024-01-05 10:11:12": dt.date(2024, 1, 5),
        "2024-01-05T23:59:59-03:00": dt.date(2024, 1, 5),
        "05/01/2024": dt.date(2024, 1, 5),
        "05/01/2024 10:00": dt.date(2024, 1, 5),
    }
    bad = ["2024-02-30", "31/02/2024", "5/1/2024", "", None, "12345-01-01", "2024-1-5", "x2024-01-05",
           "0000-01-01", "01/01/0000"]
    df = _one_col(spark, list(good) + bad)
    got = {r.x: r.d for r in df.select("x", parse_date("x").alias("d")).collect()}
    for text, want in good.items():
        assert got[text] == want, text
    for text in bad:
        assert got[text] is None, text


def test_weekday_sunday_is_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 13),)], "d date")
    assert [r.w for r in df.select(weekday("d").alias("w")).collect()] == [0, 6]


def test_month_clamp():
    assert minus_months(dt.date(2024, 8, 31), 18) == dt.date(2023, 2, 28)
    assert minus_months(dt.date(2024, 3, 31), 1) == dt.date(2024, 2, 29)
    assert minus_months(dt.date(2024, 1, 31), 12) == dt.date(2023, 1, 31)


def test_periods():
    as_of = dt.date(2024, 5, 17)
    assert default_period(as_of) == Period(dt.date(2024, 5, 1), as_of)
    assert default_period(as_of, "2024-01-01", "") == Period(dt.date(2024, 1, 1), as_of)
    p = Period(dt.date(2024, 1, 10), dt.date(2024, 1, 20))
    assert previous_period(p) == Period(dt.date(2023, 12, 30), dt.date(2024, 1, 9))
    assert sync_window(dt.date(2024, 1, 31), 7) == Period(dt.date(2024, 1, 24), dt.date(2024, 1, 30))
    assert sync_window(dt.date(2024, 1, 31), 7, start="2024-01-01") == \
        Period(dt.date(2024, 1, 1), dt.date(2024, 1, 30))


def test_status_three_valued(spark):
    df = _one_col(spark, ["Cancelado", "Cancelada", "Aprovado", None], "status")
    r = df.agg(F.count_if(not_cancelled()).alias("nc"),
               F.count_if(~not_cancelled()).alias("c"), F.count("*").alias("n")).first()
    assert (r.nc, r.c, r.n) == (1, 2, 4)   # NULL status is in neither


def test_first_label(spark):
    df = spark.createDataFrame([("", "mk"), (None, ""), ("web", "mk"), (None, None)], "a string, b string")
    got = [r.x for r in df.select(first_label("a", "b", default="Direto").alias("x")).collect()]
    assert got == ["mk", "Direto", "web", "Direto"]


def test_safe_pct_rounding(spark):
    df = spark.createDataFrame([(1, 16), (1, 8), (0, 0), (2, 3), (1, 40)], "n long, d long")
    got = [r.p for r in df.select(safe_pct(F.col("n"), F.col("d"), 1).alias("p")).collect()]
    assert got == [Decimal("6.3"), Decimal("12.5"), None, Decimal("66.7"), Decimal("2.5")]


def test_zero_impressions(spark):
    df = spark.createDataFrame([(5, 0, Decimal("3.00")), (1, 3, Decimal("2.00"))],
                               "clicks long, impressions long, position decimal(6,2)")
    out = df.select(click_rate(F.col("clicks"), F.col("impressions")).alias("ctr"),
                    weighted_position(F.col("position") * F.col("impressions"),
                                      F.col("impressions")).alias("pos")).collect()
    assert (out[0].ctr, out[0].pos) == (Decimal("0.00"), Decimal("0.0"))
    assert (out[1].ctr, out[1].pos) == (Decimal("33.33"), Decimal("2.0"))


def test_shipment_classifier_accents(spark):
    texts = ["Objeto ENTREGUE ao destinatário", "Objeto saiu para entrega", "saiu p/ entrega",
             "OBJETO EM TRÂNSITO", "em transito", "Em transferência", "Objeto postado", None,
             "não entregue"]
    df = _one_col(spark, texts, "s")
    got = [r.c for r in df.select(classify("s", SHIPMENT_RULES, OTHER).alias("c")).collect()]
    assert got == ["Entregue", "Saiu p/ entrega", "Saiu p/ entrega", "Em trânsito", "Outros",
                   "Em trânsito", "Postado", "Outros", "Entregue"]


def test_scale_conf_sizes_shuffles():
    from vitrine.session import scale_conf
    conf = scale_conf(100 * 2**40)                    # 100 TB on 1000 x 4 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20) + 1
    small = scale_conf(10 * 2**30)
    assert int(small["spark.sql.shuffle.partitions"]) == 4000     # at least one task per slot


def test_refresh_window_values_cross_the_year():
    from vitrine.sources.curated import _window_values
    months = _window_values("sale_month", dt.date(2023, 11, 1), dt.date(2024, 2, 1))
    assert months == [dt.date(2023, 11, 1), dt.date(2023, 12, 1), dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    days = _window_values("day", dt.date(2023, 12, 30), dt.date(2024, 1, 2))
    assert len(days) == 4 and days[-1] == dt.date(2024, 1, 2)
