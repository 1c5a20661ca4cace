"""DataFrame -> DataFrame operators shared by the queries."""

from .activity import activity_summary, dormant_count, dormant_in_state, frequency_bands, repeat_count
from .cumulative import abc_full, abc_top
from .inventory import last_sale_of, not_sold_since
from .period import Period, default_period, in_period, previous_period, sync_window
from .shaping import bundle, top_k

__all__ = [
    "Period", "abc_full", "activity_summary", "abc_top", "bundle", "default_period",
    "dormant_count", "dormant_in_state", "frequency_bands", "in_period", "last_sale_of", "not_sold_since",
    "previous_period", "repeat_count", "sync_window", "top_k",
]
