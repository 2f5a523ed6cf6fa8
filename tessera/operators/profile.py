"""Dataset profile.

All of it is one or two aggregates plus an ordered top-k: the missing counts of
every column come from a single ``agg`` (``count(*) - count(c)``) unpivoted
with ``explode``, and previews take the first rows by a key, or by place in the
files, with Spark's top-k (no global sort of the data).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import as_text, is_missing
from tessera.sinks import report_document


def _c(name: str):
    return F.col(f"`{name}`")


def shape(df: DataFrame) -> DataFrame:
    """A1: one row ``(n_rows, n_cols)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_cols"))


def missing_counts(df: DataFrame) -> DataFrame:
    """A2: ``(position, column, n_missing)`` for every column, one aggregate pass (NaN is missing)."""
    # long form: the plan stays the same size however wide the table is
    items = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), is_missing(_c(f.name), f.dataType).alias("m"))
             for i, f in enumerate(df.schema.fields)]
    return (df.select(F.explode(F.array(*items)).alias("r")).select("r.*")
            .groupBy("position", "column").agg(F.count_if("m").alias("n_missing")))


def top_missing(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` columns with most missing values (ties by column position)."""
    return missing_counts(df).orderBy(F.desc("n_missing"), "position").limit(k)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in the order of the files: by path, then by place in the file.

    Files are read one, two, four ... at a time until they hold ``n`` rows, so a large table costs its first files only.
    Parquet rows are ordered by their number in the file, wherever a shuffle may have put them; rows of other formats by
    the start of their split and their order in it. A frame that is not read from files row by row (an aggregate, a join,
    rows made in memory) has no such order: there any ``n`` rows are returned.
    """
    def places(fields: list[str]) -> DataFrame:
        return df.select("*", *[F.col(f"_metadata.{f}").alias(f"__{f}") for f in fields])

    at = None
    if "_metadata" not in (c.lower() for c in df.columns):
        for fields in (["file_path", "row_index"], ["file_path", "file_block_start"]):
            try:
                at = places(fields)
                break
            except AnalysisException:  # no files below, or a format without row numbers
                continue
    if at is None:
        return df.limit(n)
    order = [f"__{f}" for f in fields]
    if "row_index" not in fields:
        at, order = at.withColumn("__row", F.monotonically_increasing_id()), [*order, "__row"]
    # _metadata writes local paths with one slash, the list of files with three
    files = sorted(f.replace("file:///", "file:/", 1) if f.startswith("file:///") else f for f in df.inputFiles())
    begin, step = 0, 1
    while begin + step < len(files):
        some = at.where(F.col("__file_path").isin(files[:begin + step]))
        if some.limit(n).count() >= n:
            at = some
            break
        begin, step = begin + step, 2 * step
    return at.orderBy(*order).limit(n).select(*[_c(c) for c in df.columns])


def preview(df: DataFrame, n: int = 30, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows, every cell as text, in key order when a key is given, else in file order."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.orderBy(*[_c(c) for c in order_by]).limit(n) if order_by else first_rows(df, n)
    return rows.select(*[as_text(_c(c), types[c]).alias(c) for c in df.columns])


def _csv_field(c):
    needs_quotes = c.rlike('[,"\\r\\n]')
    quoted = F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    return F.coalesce(F.when(needs_quotes, quoted).otherwise(c), F.lit(""))


def head_csv(df: DataFrame, n: int = 12, order_by: list[str] | None = None) -> DataFrame:
    """T4: ``(line_no, line)``: the header (line 0) and the first ``n`` rows as CSV lines."""
    from pyspark.sql import Window

    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    if order_by:
        rows = df.orderBy(*[_c(c) for c in order_by]).limit(n)
        order = [_c(c) for c in order_by]
    else:
        rows = first_rows(df, n).withColumn("__k", F.monotonically_increasing_id())
        order = [F.col("__k")]
    # at most n rows reach this window
    lines = rows.select(F.row_number().over(Window.orderBy(*order)).cast("int").alias("line_no"),
                        F.concat_ws(",", *[_csv_field(as_text(_c(c), types[c])) for c in df.columns]).alias("line"))
    head = spark.createDataFrame([(0, ",".join(df.columns))], "line_no int, line string")
    return head.unionByName(lines)


def profile_frame(spark: SparkSession, df: DataFrame, source: str = "(not saved)", report: dict | None = None,
                  order_by: list[str] | None = None) -> DataFrame:
    """One tidy ``(section, name, value)`` table: source, shape, dtypes, top-10
    missing, the first 12 rows as CSV, and the report as JSON text."""
    parts = [spark.createDataFrame([("source", "csv_name", source)], "section string, name string, value string")]
    parts.append(shape(df).select(F.explode(F.array(*[
        F.struct(F.lit("shape").alias("section"), F.lit(k).alias("name"), F.col(c).cast("string").alias("value"))
        for k, c in (("rows", "n_rows"), ("cols", "n_cols"))])).alias("r")).select("r.*"))
    parts.append(spark.createDataFrame([("dtype", f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                       "section string, name string, value string"))
    parts.append(top_missing(df, 10).select(F.lit("missing").alias("section"), F.col("column").alias("name"),
                                            F.col("n_missing").cast("string").alias("value")))
    parts.append(head_csv(df, 12, order_by).select(F.lit("preview").alias("section"),
                                                   F.col("line_no").cast("string").alias("name"),
                                                   F.col("line").alias("value")))
    parts.append(spark.createDataFrame([("report", "json", report_document(report or {}))],
                                       "section string, name string, value string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
