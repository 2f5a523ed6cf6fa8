"""Derived views used by the registered queries (FIXTURES.md §B).

Each view is written twice, identically: as a DataFrame here and as SQL text
(``SQL_VIEWS``) for the DuckDB oracle. Nulls are injected by a rule on whole
tables (the driver's tables contain none); no rows are filtered out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.parquet import read_table

EMBED_DIM = 64


def _null_when(cond, c: str):
    return F.when(cond, F.lit(None)).otherwise(F.col(c)).alias(c)


def orders_nulls(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", _null_when(k % 7 == 0, "o_totalprice"),
                    "o_orderdate", _null_when(k % 11 == 0, "o_orderpriority"))


def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     _null_when(F.col("l_orderkey") % 10 == 0, "l_quantity"), "l_extendedprice",
                     _null_when(F.col("l_partkey") % 7 == 0, "l_discount"),
                     _null_when(F.col("l_linenumber") % 4 == 0, "l_tax"),
                     _null_when(F.col("l_suppkey") % 3 == 0, "l_returnflag"), "l_linestatus", "l_shipdate")


LINEITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def lineitem_reg(spark: SparkSession, sf: str) -> DataFrame:
    """Regression view: features, the derived target ``net`` and the unique key."""
    li = read_table(spark, sf, "lineitem")
    return li.select(*LINEITEM_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


def lineitem_cls(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(*LINEITEM_KEY, "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                     (F.col("l_quantity") > 25).alias("is_big"))


def labels_pred(spark: SparkSession, sf: str) -> DataFrame:
    lb = read_table(spark, sf, "labels")
    return lb.select("doc_id", F.col("quality").cast("string").alias("y_true"),
                     F.col("toxic").cast("string").alias("y_pred"))


def lineitem_pred(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(*LINEITEM_KEY, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y_true"),
                     (F.col("l_extendedprice") * 0.95).alias("y_pred"))


def part_num(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")


def embeddings_cols(spark: SparkSession, sf: str) -> DataFrame:
    """``embedding`` (array<float>, 64-d) as 64 numeric columns e0..e63."""
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMBED_DIM)],
                    "label")


def lineitem_nan(spark: SparkSession, sf: str) -> DataFrame:
    """NaN and null side by side in two columns."""
    li, nan = read_table(spark, sf, "lineitem"), F.lit(float("nan"))
    return li.select(*LINEITEM_KEY, F.when(F.col("l_orderkey") % 9 == 0, nan).when(F.col("l_orderkey") % 10 == 0, None)
                     .otherwise(F.col("l_quantity")).alias("l_quantity"),
                     F.when(F.col("l_partkey") % 4 == 0, nan).otherwise(F.col("l_tax")).alias("l_tax"), "l_returnflag")


def events_nan(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", ["event_id", "value"])
    return ev.select("event_id", F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, None)
                     .otherwise(F.col("value")).alias("value"))


def lineitem_clash(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem_reg`` with features named like columns an engine might add."""
    return (lineitem_reg(spark, sf).withColumnRenamed("l_quantity", "is_test").withColumnRenamed("l_extendedprice", "_h")
            .withColumnRenamed("l_discount", "row_key").withColumnRenamed("l_tax", "features"))


def orders_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One text feature with up to 6,000 levels."""
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    return o.select("o_orderkey", "o_totalprice", F.concat(F.lit("k"), (F.col("o_orderkey") % 6000).cast("string")).alias("level"))


def orders_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of every kind that type inference tells apart."""
    o, k = read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]), F.col("o_orderkey")
    none = F.lit(None).cast("string")
    return o.select(k.cast("string").alias("whole"), F.when(k % 3 == 0, none).otherwise(k.cast("string")).alias("whole_na"),
                    F.when(k % 2 == 0, "True").otherwise("false").alias("flag"), F.when(k % 5 == 0, none).otherwise(F.lit("TRUE")).alias("flag_na"),
                    none.alias("nothing"), F.when(k % 4 == 0, "1e5").when(k % 4 == 1, "-.5").when(k % 4 == 2, "inf").otherwise("7").alias("number"),
                    F.when(k % 10 == 0, "x").otherwise("1").alias("nearly"), F.lit("99999999999999999999").alias("huge"),
                    F.when(k % 2 == 0, "True").otherwise("1").alias("mixed"), F.col("o_totalprice").cast("string").alias("price"))


def lineitem_steps(spark: SparkSession, sf: str) -> DataFrame:
    li, n = read_table(spark, sf, "lineitem", LINEITEM_KEY), F.col("l_linenumber")
    return li.select(*LINEITEM_KEY, n.cast("double").alias("number"), (n * n).cast("double").alias("step"),
                     F.when(n <= 2, "low").when(n <= 4, "middle").otherwise("high").alias("size_class"))


def lineitem_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Three groups of unequal size, far apart in both features."""
    li, g = read_table(spark, sf, "lineitem", [*LINEITEM_KEY, "l_quantity"]), F.col("l_linenumber") % 3
    return li.select(*LINEITEM_KEY, g.alias("grp"), (g * 10000 + F.col("l_quantity")).cast("double").alias("x"),
                     (F.when(g == 1, 10000).otherwise(0) + F.col("l_partkey") % 10).cast("double").alias("y"))


def nation_flag(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "nation", ["n_nationkey", "n_regionkey"]).select(
        "n_nationkey", F.when(F.col("n_regionkey") == 0, 1).otherwise(0).alias("first_region"))


SQL_VIEWS = {
    "orders_nulls": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
               o_orderdate,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    "lineitem_nulls": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
               l_extendedprice,
               CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
               CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_tax END AS l_tax,
               CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
               l_linestatus, l_shipdate
        FROM lineitem""",
    "lineitem_reg": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_extendedprice * (1 - l_discount) AS net
        FROM lineitem""",
    "labels_pred": """
        SELECT doc_id, CAST(quality AS VARCHAR) AS y_true, CAST(toxic AS VARCHAR) AS y_pred FROM labels""",
    "lineitem_pred": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               l_extendedprice * (1 - l_discount) AS y_true, l_extendedprice * 0.95 AS y_pred
        FROM lineitem""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the named derived views as CTEs."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"
