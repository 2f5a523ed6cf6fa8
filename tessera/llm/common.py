"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.session import scratch_path

#: A-Z to a-z on bytes; every other byte stays (contract: only A-Z are lowered).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Results that a task holds as Python objects at once.
ROWS_AT_ONCE = 1024


def load(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*cols) if cols else df


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared scratch folder and read it back: lineage is cut by files
    that survive lost executors, and later passes do not repeat the work above."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered, as UTF-8 bytes (null: none)."""
    return text.encode().translate(LOWER).split() if text else []


def row_udf(kind: str, start: Callable[[], Callable]) -> Callable[..., Column]:
    """A column function of one text column through ``start()(text)``; ``start`` runs once per task and
    may hold a cache. Only that column goes to Python; all others stay where they are."""
    arrow = to_arrow_type(T.DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = start()
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                yield pa.array([f(x.as_py()) for x in batch.slice(at, ROWS_AT_ONCE)], type=arrow)

    return run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use (names are compared without case, as Spark does)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def components(spark: SparkSession, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)`` by repeated contraction: ``(node, root)``, one row per
    node that has an edge to another node.

    Each round hooks every node to its neighbour (or itself) of the smallest round-salted hash, then
    replaces the edges' ends by their hooks and drops loops and repeats. With a random order a
    constant share of the nodes goes in each round, chains included, so the rounds are logarithmic.
    The minimum is combined before the shuffle, hence a hub with a third of all edges is one partial
    row per task; the two joins on the hub are ordinary equi-joins that adaptive execution splits.
    """
    edges = materialize(spark, edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    mapping = None
    rounds = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def order(c: str):
            return F.struct(F.xxhash64(F.col(c), F.lit(rounds)).alias("h"), F.col(c).alias("n"))

        low = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        hook = materialize(spark, low.select(F.col("a").alias("u"), F.least(F.col("m"), order("a"))["n"].alias("v")), f"{name}-hook")
        if mapping is None:
            mapping = hook.select(F.col("u").alias("node"), F.col("v").alias("root"))
        else:
            mapping = mapping.join(hook, mapping["root"] == hook["u"], "left").select("node", F.coalesce("v", "root").alias("root"))
        mapping = materialize(spark, mapping, f"{name}-map")
        ha, hb = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        edges = edges.join(ha, "a").join(hb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = materialize(spark, edges, f"{name}-edges")
        rounds += 1
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping
