"""Profiling: moments, quantiles, value frequencies, alerts and whole reports."""

from .frequencies import (
    approximate_summary,
    boolean_counts,
    datetime_profile,
    distinct_counts,
    frequent_values,
    imbalance,
    top_values,
    value_frequencies,
)
from .moments import grouped_profile, numeric_profile, table_profile
from .order import monotonic_profile
from .quantiles import (
    grouped_histogram,
    grouped_median_absolute_deviation,
    grouped_quantiles,
    histogram,
    median_absolute_deviation,
    quantiles,
)
from .report import alerts, profile_json, profile_report
from .states import column_states, refresh_states, state_sections, stored_states

__all__ = [
    "alerts",
    "approximate_summary",
    "boolean_counts",
    "column_states",
    "datetime_profile",
    "distinct_counts",
    "frequent_values",
    "grouped_histogram",
    "grouped_median_absolute_deviation",
    "grouped_profile",
    "grouped_quantiles",
    "histogram",
    "imbalance",
    "median_absolute_deviation",
    "monotonic_profile",
    "numeric_profile",
    "profile_json",
    "profile_report",
    "quantiles",
    "refresh_states",
    "state_sections",
    "stored_states",
    "table_profile",
    "top_values",
    "value_frequencies",
]
