"""Date handling as Column expressions (all JVM-side, no UDF).

O1  parse_date       text holding ``YYYY-MM-DD...`` or ``DD/MM/YYYY...`` -> DATE
O18 calendar buckets month text, month start, year, month, weekday, hour
O19 relative cutoffs  as_of minus days / months / years
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two accepted date layouts, anchored at the start of the
# text only, so a time or zone suffix after the date is ignored.
ISO_PREFIX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
DMY_PREFIX = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: Column | str) -> Column:
    """O1: mixed-layout text to DATE; anything else (also '', NULL,
    impossible days such as 2024-02-30, and year 0000, which a SQL date
    rejects) becomes NULL."""
    c = _col(c)
    iso = F.substring(c, 1, 10)
    dmy = F.concat_ws("-", F.substring(c, 7, 4), F.substring(c, 4, 2), F.substring(c, 1, 2))
    return (F.when(c.rlike(ISO_PREFIX) & (F.substring(c, 1, 4) != "0000"), iso.try_cast("date"))
             .when(c.rlike(DMY_PREFIX) & (F.substring(c, 7, 4) != "0000"), dmy.try_cast("date")))


def parse_timestamp(c: Column | str) -> Column:
    """Text to TIMESTAMP_NTZ (a zone suffix is dropped, as a zone-less
    timestamp does); unparseable text becomes NULL."""
    return _col(c).try_cast("timestamp_ntz")


def month_text(d: Column | str) -> Column:
    """'YYYY-MM' of a date."""
    return F.date_format(_col(d), "yyyy-MM")


def month_start(d: Column | str) -> Column:
    return F.trunc(_col(d), "month")


def weekday(d: Column | str) -> Column:
    """Day of week with Sunday = 0 ... Saturday = 6."""
    return F.dayofweek(_col(d)) - 1


def minus_days(as_of: dt.date, days: int) -> dt.date:
    return as_of - dt.timedelta(days=days)


def minus_months(as_of: dt.date, months: int) -> dt.date:
    """Calendar months back, clamping the day to the month's end
    (2024-08-31 minus 18 months is 2023-02-28)."""
    total = as_of.year * 12 + (as_of.month - 1) - months
    year, month = divmod(total, 12)
    month += 1
    next_first = dt.date(year + (month == 12), month % 12 + 1, 1)
    last_day = (next_first - dt.timedelta(days=1)).day
    return dt.date(year, month, min(as_of.day, last_day))


def minus_years(as_of: dt.date, years: int) -> dt.date:
    return minus_months(as_of, 12 * years)


def first_of_month(as_of: dt.date) -> dt.date:
    return as_of.replace(day=1)
