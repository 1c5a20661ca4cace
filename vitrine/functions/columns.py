"""Reusable Column expressions for the dashboard measures.

O4  status predicates (not cancelled / cancelled, three-valued like SQL)
O5  conditional aggregates
O6  first non-empty label
O7  safe percentage, exact decimal rounding
O8  weighted average (search position)
O9  click-through rate
O15 ordered pattern classifier
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status texts that mark a cancelled sale.
CANCELLED = ("Cancelado", "Cancelada")

MONEY = "decimal(18,2)"        # a stored amount
MONEY_SUM = "decimal(38,2)"    # a sum of amounts (room for 100 TB of sales)
EXACT = "decimal(20,0)"        # integer operand of an exact division


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_cancelled(status: Column | str = "status") -> Column:
    """NOT IN the cancelled texts; NULL for a NULL status, so such a row is
    neither cancelled nor not-cancelled."""
    return ~_col(status).isin(*CANCELLED)


def cancelled(status: Column | str = "status") -> Column:
    return _col(status).isin(*CANCELLED)


def count_where(pred: Column) -> Column:
    """COUNT(*) FILTER (WHERE pred) as BIGINT."""
    return F.count_if(pred).cast("bigint")


def sum_where(x: Column | str, pred: Column) -> Column:
    """SUM(x) FILTER (WHERE pred); NULL when no row qualifies."""
    return F.sum(F.when(pred, _col(x)))


def money_sum(x: Column | str, pred: Column | None = None, zero_if_empty: bool = False) -> Column:
    s = F.sum(_col(x)) if pred is None else sum_where(x, pred)
    if zero_if_empty:
        s = F.coalesce(s, F.lit(0))
    return s.cast(MONEY_SUM)


def mean(x: Column | str, pred: Column | None = None) -> Column:
    """AVG(x) [FILTER (WHERE pred)] as DOUBLE: the exact decimal sum divided
    by the count, so the value does not depend on summation order."""
    x = _col(x) if pred is None else F.when(pred, _col(x))
    return F.sum(x).cast("double") / F.nullif(F.count(x), F.lit(0))


def first_label(*cols: Column | str, default: str | None = None) -> Column:
    """COALESCE(NULLIF(a,''), NULLIF(b,''), ..., default)."""
    parts = [F.nullif(_col(c), F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def ratio_rounded(num: Column, den: Column, scale: int, times: int = 1) -> Column:
    """ROUND(times * num / den, scale) with exact decimal arithmetic and
    HALF_UP rounding; NULL when den is 0 or NULL. ``num`` and ``den`` must be
    integer valued (counts, or amounts already scaled to cents)."""
    q = (num * times).cast(EXACT) / F.nullif(den, F.lit(0)).cast(EXACT)
    return F.round(q, scale)


def safe_pct(num: Column, den: Column, scale: int = 1) -> Column:
    """ROUND(100.0 * num / NULLIF(den, 0), scale) for counts."""
    return ratio_rounded(num, den, scale, times=100).cast(f"decimal(38,{scale})")


def click_rate(clicks: Column, impressions: Column) -> Column:
    """100 * clicks / impressions rounded to 2, 0 without impressions."""
    return F.when(impressions > 0, ratio_rounded(clicks, impressions, 2, times=100)) \
        .otherwise(F.lit(0)).cast("decimal(38,2)")


def weighted_position(sum_pos_x_weight: Column, sum_weight: Column) -> Column:
    """SUM(position * impressions) / SUM(impressions) rounded to 1, 0
    without impressions. The numerator has scale 2, so it is scaled to an
    integer first and the quotient divided by 100."""
    scaled = (sum_pos_x_weight * 100).cast(EXACT)
    q = ratio_rounded(scaled, sum_weight * 100, 1)
    return F.when(sum_weight > 0, q).otherwise(F.lit(0)).cast("decimal(8,1)")


def classify(c: Column | str, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """The first rule whose ILIKE pattern matches wins, else ``default``.
    A NULL text matches nothing and takes the default."""
    c = _col(c)
    expr = None
    for patterns, label in rules:
        cond = None
        for p in patterns:
            m = c.ilike(p)
            cond = m if cond is None else (cond | m)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))
