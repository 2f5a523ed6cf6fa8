"""CSV source (S1-S3): header names, NA markers and type inference.

The file is scanned once as all-string columns; one aggregate pass then decides
each column's type (S2) with the reference reader's rules, and a projection casts
the columns. Nothing but the header row and the columns' types reaches the driver.

Quoted fields may hold line breaks. A first pass over the lines (only if any has a quote) tells
whether one does and where the splits' records begin; then records are cut in splits too (``records``),
no file is read whole. Rows with more fields than the header are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import FALSE_STRINGS, NA_STRINGS, TRUE_STRINGS
from tessera.sources.records import Records, find_records

_INT_RE = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT_RE = r"(?i)^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?inf(inity)?)\s*$"


def dedupe_names(names: list[str]) -> list[str]:
    """Header names as the reference's reader yields them: blanks become
    ``Unnamed: i`` and repeats get ``.1``, ``.2`` ... suffixes. Names that differ in
    case alone are one name to Spark, so they count as repeats."""
    out: list[str] = []
    taken: set[str] = set()
    next_suffix: dict[str, int] = {}
    for i, raw in enumerate(names):
        name = raw if raw != "" else f"Unnamed: {i}"
        if name.lower() in taken:
            k = next_suffix.get(name.lower(), 1)
            while f"{name}.{k}".lower() in taken:
                k += 1
            next_suffix[name.lower()] = k + 1
            name = f"{name}.{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted_breaks(spark: SparkSession, path: str) -> Records | None:
    """The records of the file, if quoted fields hold line breaks; None if every line is a record."""
    if spark.read.text(path).where(F.contains("value", F.lit('"'))).isEmpty():
        return None
    found = find_records(spark, path)
    return found if found.breaks else None


def _reader(spark: SparkSession, multi_line: bool):
    return spark.read.option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE")


def read_header(spark: SparkSession, path: str, multi_line: bool = False) -> list[str]:
    """Column names from the file's first row, blank lines left out (one row to the driver)."""
    if spark.read.text(path).where(F.trim("value") != "").isEmpty():
        raise ValueError("No columns to parse from file")
    first = _reader(spark, multi_line).option("header", False).csv(path).first()
    return dedupe_names([(c or "").lstrip("\ufeff").rstrip("\r") for c in first])


def scan_strings(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Every column as a string, NA markers already NULL. ``multi_line`` False promises that no quoted field
    holds a line break; None and True look."""
    records = None if multi_line is False else quoted_breaks(spark, path)
    names = read_header(spark, path, records is not None)
    extra = "__extra_field"
    if records is None:
        schema = T.StructType([T.StructField(n, T.StringType(), True) for n in [*names, extra]])
        raw = _reader(spark, False).option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    else:
        kinds = ", ".join(f"c{i} string" for i in range(len(names) + 1))
        parsed = F.from_csv("record", kinds, {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
        raw = records.frame().select(parsed.alias("r")).select("r.*").toDF(*names, extra)
    # a field beyond the header is an error, whichever columns are read later
    too_long = F.raise_error(F.lit(f"Error tokenizing data: a row has more than {len(names)} fields."))
    raw = raw.where(F.when(F.col(extra).isNull(), F.lit(True)).otherwise(too_long.cast("boolean")))
    return raw.select(*[_na_to_null(F.col(f"`{n}`")).alias(n) for n in names])


def _na_to_null(c: Column) -> Column:
    return F.when(c.isin(NA_STRINGS), F.lit(None).cast("string")).otherwise(c)


def inference_frame(df_str: DataFrame) -> DataFrame:
    """S2 as a DataFrame ``(position, column, inferred_type)``, one aggregate pass over the cells in long
    form, so the plan has the same size for any number of columns.

    Rules: no value -> double; all integers (that fit 64 bits) -> bigint; all
    numbers -> double; all True/False spellings -> boolean; otherwise string.
    """
    cells = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.col(f"`{n}`").alias("c")) for i, n in enumerate(df_str.columns)]
    long = df_str.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    c = F.col("c")
    counts = long.groupBy("position", "column").agg(
        F.count(c).alias("n"),
        F.count_if(c.rlike(_INT_RE) & F.trim(c).try_cast("bigint").isNotNull()).alias("i"),
        F.count_if(c.rlike(_FLOAT_RE)).alias("f"),
        F.count_if(c.isin(TRUE_STRINGS + FALSE_STRINGS)).alias("b"))
    kind = (F.when(F.col("n") == 0, "double").when(F.col("i") == F.col("n"), "bigint").when(F.col("f") == F.col("n"), "double")
            .when(F.col("b") == F.col("n"), "boolean").otherwise("string"))
    return counts.select("position", "column", kind.alias("inferred_type"))


def cast_to(c: Column, type_name: str) -> Column:
    if type_name == "bigint":
        return F.trim(c).try_cast("bigint")
    if type_name == "double":
        return F.trim(c).try_cast("double")
    if type_name == "boolean":
        return F.when(c.isin(TRUE_STRINGS), F.lit(True)).when(c.isin(FALSE_STRINGS), F.lit(False))
    return c


def apply_types(df_str: DataFrame, types: dict[str, str]) -> DataFrame:
    return df_str.select(*[cast_to(F.col(f"`{n}`"), types[n]).alias(n) for n in df_str.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool | None = None) -> DataFrame:
    """S1+S2: a typed DataFrame from a header-row CSV file or folder.

    A user-supplied ``schema`` (the production path for recurring loads) skips
    the inference pass; its names replace the header's.
    """
    df_str = scan_strings(spark, path, multi_line)
    if schema is not None:
        renamed = df_str.toDF(*[f.name for f in schema.fields])
        return renamed.select(*[cast_to(F.col(f"`{f.name}`"), f.dataType.simpleString()).cast(f.dataType)
                                .alias(f.name) for f in schema.fields])
    inferred = dict.fromkeys(df_str.columns, "double")  # a table without rows has no other evidence
    inferred.update((r["column"], r["inferred_type"]) for r in inference_frame(df_str).collect())
    return apply_types(df_str, inferred)
