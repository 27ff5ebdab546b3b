"""Column expressions: arithmetic on catch, labels, bins, and NULL-aware filters and sums."""

from .aggregates import mean_of, n_distinct, sum_of
from .predicates import between_open, complete_cases, is_present, not_in
from .scalar import (
    as_levels,
    classify_boxes,
    cpue,
    cut,
    drop_prefix,
    override,
    paste,
    recode,
    relative_to_mean,
    strip_token,
)

__all__ = [
    "mean_of", "n_distinct", "sum_of", "between_open", "complete_cases", "is_present", "not_in",
    "as_levels", "classify_boxes", "cpue", "cut", "drop_prefix", "override", "paste", "recode",
    "relative_to_mean", "strip_token",
]
