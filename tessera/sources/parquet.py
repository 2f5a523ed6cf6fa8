"""Parquet source and source metadata."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import is_categorical, is_numeric, normalize_nulls


BALANCE_BYTES = 256 << 20  # only scans of at most so many bytes are spread


def balance_partitions(df: DataFrame) -> DataFrame:
    """Spread a small Parquet scan over the cores when it has fewer splits than they are.

    A Parquet row group is the smallest unit a scan can split, so a small file
    written as one row group is read by one task and every expression above it
    runs single-threaded. The spread hashes Parquet's row index: deterministic on
    recomputation and without the sort of a round-robin. It shuffles the rows, so
    it is opt-in and bounded: a scan above ``BALANCE_BYTES`` is left as it is.
    ``df`` must be the scan itself (the hidden ``_metadata`` column is read).
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    target = df.sparkSession.sparkContext.defaultParallelism
    if size <= BALANCE_BYTES and df.rdd.getNumPartitions() < target:
        return df.repartition(target, F.col("_metadata.row_index"))
    return df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None,
                 balance: bool = False, normalize_nan: bool = False) -> DataFrame:
    """Columnar scan; a column list is pruned at the reader.

    NaN is read as missing by the operators themselves (``num_value``), so the
    scan stays a plain scan and filters on it push down to Parquet;
    ``normalize_nan=True`` rewrites NaN to NULL here instead.
    """
    df = spark.read.parquet(path)
    if balance:
        df = balance_partitions(df)
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    return normalize_nulls(df) if normalize_nan else df


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the registered queries: its small single-row-group files are spread over the cores."""
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", columns, balance=True)


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Load a table the way a user of the reference would: CSV (inferred) or Parquet.

    The format comes from ``fmt`` or the path's extension (works for any
    filesystem URI; nothing is listed on the driver).
    """
    from tessera.sources.csv import read_csv

    fmt = (fmt or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")).lower()
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"Unsupported format: {fmt}")


def source_name(path: str | None) -> str:
    """The file name, or ``(not saved)`` when there is none."""
    return os.path.basename(path.rstrip("/")) if path else "(not saved)"


def role_of(dt: T.DataType) -> str:
    if is_numeric(dt):
        return "numeric"
    if is_categorical(dt):
        return "categorical"
    return "excluded"


def dtypes_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``(position, column, dtype, role)`` from the schema (metadata only)."""
    rows = [(i, f.name, f.dataType.simpleString(), role_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    schema = "position int, column string, dtype string, role string"
    return spark.createDataFrame(rows, schema)
