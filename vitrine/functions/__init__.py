"""Column-returning helpers (all built-in Spark expressions)."""

from .columns import (CANCELLED, cancelled, classify, click_rate, count_where, first_label,
                      mean, money_sum, not_cancelled, ratio_rounded, safe_pct, sum_where,
                      weighted_position)
from .dates import (minus_days, minus_months, minus_years, month_start, month_text,
                    parse_date, parse_timestamp, weekday)

__all__ = [
    "CANCELLED", "cancelled", "classify", "click_rate", "count_where", "first_label",
    "mean", "minus_days", "minus_months", "minus_years", "money_sum", "month_start",
    "month_text", "not_cancelled", "parse_date", "parse_timestamp", "ratio_rounded",
    "safe_pct", "sum_where", "weekday", "weighted_position",
]
