"""Column-level functions."""

from saleslens.functions.columns import (  # noqa: F401
    age_band,
    all_named,
    amount_edges,
    amount_labels,
    cents,
    combo_label,
    combo_listed,
    cut,
    dashboard_age_band,
    epoch,
    first_named,
    income_lower_bound,
    label_probability,
    month_of,
    quarter_label,
    priority_band,
    series_name,
)
