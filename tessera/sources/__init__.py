"""Sources: CSV with inference (the reference's only input) and Parquet."""

from tessera.sources.csv import dedupe_names, inference_frame, read_csv, scan_strings  # noqa: F401
from tessera.sources.parquet import dtypes_frame, load, read_parquet, read_table, source_name  # noqa: F401
