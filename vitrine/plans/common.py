"""Shared pieces of the dashboard queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import not_cancelled
from ..operators.period import Period, default_period
from ..sources.tables import Tables


def resolve(as_of: dt.date, period: Period | tuple | None) -> Period:
    if period is None:
        return default_period(as_of)
    return period if isinstance(period, Period) else default_period(as_of, *period)


def dated_between(df: DataFrame, start: dt.date, end: dt.date | None = None,
                  day: str = "sale_date", month: str = "sale_month") -> DataFrame:
    """Rows dated start..end (end None: no upper bound); NULL dates drop out.

    On a curated copy partitioned by ``month`` the implied month range is
    added as well, so whole month folders are skipped (partition pruning)
    before the date predicate is pushed into the remaining files."""
    d = F.col(day)
    cond = d >= F.lit(start) if end is None else d.between(F.lit(start), F.lit(end))
    if month in df.columns:
        m = F.col(month)
        first = F.lit(start.replace(day=1))
        cond = cond & (m >= first if end is None else m.between(first, F.lit(end.replace(day=1))))
    return df.where(cond)


def sales_between(t: Tables, start: dt.date, end: dt.date | None = None) -> DataFrame:
    return dated_between(t["sales"], start, end)


def sales_in(t: Tables, period: Period) -> DataFrame:
    """Sales whose parsed date lies in the period (NULL dates drop out)."""
    return sales_between(t, period.start, period.end)


def items_of_live_sales(t: Tables, period: Period) -> DataFrame:
    """Order lines of not-cancelled sales in the period (inner equi join).

    On curated lines, which carry their sale's date and status, this is a
    pruned scan with no join. Otherwise the sale side is filtered and pruned
    to its key before the join, so only the qualifying sale ids are shuffled
    (or broadcast, when AQE sees they are small)."""
    items = t["sale_items"]
    if "sale_status" in items.columns:
        return dated_between(items, period.start, period.end).where(not_cancelled("sale_status"))
    live = sales_in(t, period).where(not_cancelled()).select("sale_id")
    return t["sale_items"].join(live, "sale_id")


def rows() -> Column:
    """COUNT(*) as BIGINT."""
    return F.count(F.lit(1)).cast("bigint")


def desc(c: str) -> Column:
    """Descending with NULLs first, as a descending SQL sort orders them."""
    return F.col(c).desc_nulls_first()


def asc(c: str) -> Column:
    return F.col(c).asc_nulls_last()
