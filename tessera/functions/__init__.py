"""Column-level expressions (null markers, roles, z-score, bins, keys)."""

from tessera.functions.columns import (  # noqa: F401
    FALSE_STRINGS,
    NA_STRINGS,
    TRUE_STRINGS,
    as_text,
    categorical_columns,
    equal_width_bin,
    is_categorical,
    is_numeric,
    key_text,
    normalize_nulls,
    num_value,
    numeric_columns,
    zscore,
)
