"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The missing-value markers of the reference's CSV reader (pandas
# defaults), in the library's documented order.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The spellings the reference's CSV reader turns into booleans.
TRUE_STRINGS = ["True", "TRUE", "true"]
FALSE_STRINGS = ["False", "FALSE", "false"]

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(dt: T.DataType) -> bool:
    """The reference's only type test: a number (booleans are not numbers)."""
    return isinstance(dt, NUMERIC_TYPES)


def is_categorical(dt: T.DataType) -> bool:
    """Everything the reference one-hot encodes: strings and booleans.

    Timestamps, dates, arrays, maps and binaries are not features by default
    (they would explode one-hot); callers can cast them to strings explicitly.
    """
    return isinstance(dt, (T.StringType, T.BooleanType, T.CharType, T.VarcharType))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_categorical(f.dataType) and f.name not in exclude]


def num_value(c: Column) -> Column:
    """A numeric cell as double with NaN read as missing (one missing concept).

    Applied where values are consumed (statistics, filling) rather than at the
    scan, so predicates on raw columns still push down to Parquet.
    """
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def is_missing(c: Column, dt: T.DataType) -> Column:
    """Null, or NaN in a floating-point column."""
    return c.isNull() | F.isnan(c) if isinstance(dt, (T.FloatType, T.DoubleType)) else c.isNull()


def normalize_nulls(df: DataFrame) -> DataFrame:
    """One missing concept: NaN in float columns becomes NULL, once, at the scan."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
            changed = True
        else:
            exprs.append(c)
    return df.select(*exprs) if changed else df


def as_text(c: Column, dt: T.DataType) -> Column:
    """Cell text as the reference prints it: booleans as True/False, else the SQL cast."""
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def key_text(cols: list[str]) -> Column:
    """Text of a tuple of columns that differs wherever the tuples differ: backslashes and bars inside
    values are escaped, parts are joined by bars, and null is the one part that reads ``\\N``."""
    parts = []
    for c in cols:
        t = F.col(f"`{c}`").cast("string")
        escaped = F.when(t.contains("\\") | t.contains("|"), F.regexp_replace(t, r"([\\|])", r"\\$1")).otherwise(t)
        parts.append(F.coalesce(escaped, F.lit("\\N")))
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def zscore(c: Column, mean: float, std: float) -> Column:
    """Population z-score; a zero std divides by one (constant column -> 0)."""
    scale = std if std and std > 0.0 else 1.0
    return (c - F.lit(float(mean))) / F.lit(float(scale))


def equal_width_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin over [lo, hi]; the last bin is closed.

    With lo == hi the range is widened to lo-0.5 .. hi+0.5, so every value
    lands in the middle bin, as in the reference's plotting library.
    """
    lo2 = F.when(lo == hi, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(lo == hi, hi + F.lit(0.5)).otherwise(hi)
    raw = F.floor((v - lo2) * F.lit(float(bins)) / (hi2 - lo2)).cast("int")
    return F.least(raw, F.lit(bins - 1))
