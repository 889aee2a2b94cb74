"""Column-level helpers (pure Catalyst expressions) and small plan helpers."""

from vitaplate.functions.nulls import (
    finite,
    ieee_div,
    join_null_safe,
    key_concat,
    mean_strict,
    nan_to_null,
    not_in_keep_null,
    null_safe_on,
    num_label,
    text_or_na,
)
from vitaplate.functions.ranking import (
    checkpointed,
    dense_codes,
    domain_codes,
    release_materialised,
    sequence_index,
    window_index,
)

__all__ = [
    "finite", "ieee_div", "join_null_safe", "key_concat", "mean_strict", "nan_to_null", "not_in_keep_null",
    "null_safe_on", "num_label", "text_or_na", "checkpointed", "dense_codes", "domain_codes", "release_materialised",
    "sequence_index", "window_index",
]
