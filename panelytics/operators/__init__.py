"""DataFrame-to-DataFrame operators; all are lazy unless their docstring says otherwise."""

from panelytics.operators.clean import clean_panel, iso_dates, normalise_names
from panelytics.operators.corr import corr_matrix, corr_pairs
from panelytics.operators.joins import join_panels, join_summaries, joined_peaks
from panelytics.operators.profile import (
    assert_unique_keys,
    compare_profiles,
    coverage,
    duplicate_keys,
    missingness,
    rollup_labels,
    shape,
    table_profile,
)
from panelytics.operators.rank import bottom_k, head, ordered, tail, top_k
from panelytics.operators.reshape import to_series
from panelytics.operators.rollup import entity_peaks, flow_totals, real_entities
from panelytics.operators.windows import running_total, trailing_mean

__all__ = [
    "assert_unique_keys",
    "bottom_k",
    "clean_panel",
    "compare_profiles",
    "corr_matrix",
    "corr_pairs",
    "coverage",
    "duplicate_keys",
    "entity_peaks",
    "flow_totals",
    "head",
    "iso_dates",
    "join_panels",
    "join_summaries",
    "joined_peaks",
    "missingness",
    "normalise_names",
    "ordered",
    "real_entities",
    "rollup_labels",
    "running_total",
    "shape",
    "table_profile",
    "tail",
    "to_series",
    "top_k",
    "trailing_mean",
]
