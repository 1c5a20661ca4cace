"""Periods and the plan-time date arithmetic around them.

O2  default period   missing bounds -> first day of the as_of month .. as_of
O3  period filter    inclusive range on a parsed date; NULL dates drop out
O16 previous period  same length, ending the day before the period starts
J3  sync window      the N days ending the day before as_of

``as_of`` stands in for "today": it is always a parameter, never the wall
clock, so a query is reproducible.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Period(NamedTuple):
    start: dt.date
    end: dt.date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def _as_date(x: dt.date | str | None) -> dt.date | None:
    if x is None or x == "":
        return None
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(x)


def default_period(as_of: dt.date, start: dt.date | str | None = None,
                   end: dt.date | str | None = None) -> Period:
    """O2: the month to date of ``as_of`` for any missing bound."""
    return Period(_as_date(start) or as_of.replace(day=1), _as_date(end) or as_of)


def in_period(d: Column | str, period: Period) -> Column:
    """O3: d BETWEEN start AND end, both ends included."""
    d = F.col(d) if isinstance(d, str) else d
    return d.between(F.lit(period.start), F.lit(period.end))


def previous_period(period: Period) -> Period:
    """The window of equal length that ends the day before ``start``."""
    return Period(period.start - dt.timedelta(days=period.days),
                  period.start - dt.timedelta(days=1))


def sync_window(as_of: dt.date, days: int = 7, start: dt.date | str | None = None,
                end: dt.date | str | None = None) -> Period:
    """``days`` days ending yesterday; explicit bounds override."""
    end_d = _as_date(end) or as_of - dt.timedelta(days=1)
    start_d = _as_date(start) or end_d - dt.timedelta(days=days - 1)
    return Period(start_d, end_d)
