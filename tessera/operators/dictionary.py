"""Category dictionaries that never pass through the driver.

``ranked`` numbers the sorted values of each column without a single-task sort: values are dealt out by
range and sorted within their partitions, each partition counts its values of each column, and the counts
of the partitions before it are the offset of its row numbers.

``DictionaryIndexer`` looks indices up by joins with such a dictionary, and ``SparseAssembler`` puts
numeric columns and indices together as one sparse vector, whose schema does not name its features
(the library's own encoder lists every level in the schema).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

_ROW_BITS = 33  # of monotonically_increasing_id: the partition stands above them


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(values: DataFrame) -> DataFrame:
    """``(position, column, value, idx)`` from distinct ``(position, column, value)``: the 0-based rank of each
    value among the sorted ones of its column. Written to the shared folder, so it can be read often."""
    at = F.monotonically_increasing_id()
    dealt = values.select("position", "column", "value").repartitionByRange("position", "value").sortWithinPartitions("position", "value")
    dealt = _written(dealt.withColumn("at", at), "dictionary-sorted")
    part = F.shiftright("at", _ROW_BITS)
    # one row for each partition and column
    blocks = dealt.groupBy("position", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("position").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = dealt.withColumn("part", part).join(F.broadcast(blocks), ["position", "part"])
    return _written(numbered.select("position", "column", "value", (F.col("at") - F.col("first") + F.col("before")).alias("idx")), "dictionary")


class DictionaryIndexer(Transformer, MLReadable, MLWritable):
    """``outputCols[i]`` = index of ``inputCols[i]`` in the dictionary of column number ``positions[i]``, unseen values
    ``sizes[i]``. ``dictionary`` is a DataFrame ``(position, value, idx)`` and is saved with the stage."""

    inputCols = Param(Params._dummy(), "inputCols", "text columns", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "index columns", TypeConverters.toListString)
    positions = Param(Params._dummy(), "positions", "number of each column in the dictionary", TypeConverters.toListInt)
    sizes = Param(Params._dummy(), "sizes", "levels of each column", TypeConverters.toListInt)

    def __init__(self, inputCols=None, outputCols=None, positions=None, sizes=None, dictionary: DataFrame | None = None):
        super().__init__()
        self._set(inputCols=list(inputCols or []), outputCols=list(outputCols or []), positions=list(positions or []), sizes=list(sizes or []))
        self.dictionary = dictionary

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        for c, out, position, size in zip(g(self.inputCols), g(self.outputCols), g(self.positions), g(self.sizes)):
            own = self.dictionary.where(F.col("position") == position).select(F.col("value").alias("__value"), F.col("idx").alias("__at"))
            df = df.join(own, F.col(f"`{c}`") == F.col("__value"), "left")
            df = df.withColumn(out, F.coalesce(F.col("__at"), F.lit(size).cast("long"))).drop("__value", "__at")
        return df

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: DictionaryIndexer):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        self.instance.dictionary.write.mode("overwrite").parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> DictionaryIndexer:
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        out = self.cls(dictionary=self.sparkSession.read.parquet(f"{path}/data"))
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out


class SparseAssembler(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``outputCol`` = sparse vector of the numeric columns, then one-hot blocks of the index columns; an index
    of its block's size (an unseen value) sets nothing."""

    numCols = Param(Params._dummy(), "numCols", "numeric columns", TypeConverters.toListString)
    idxCols = Param(Params._dummy(), "idxCols", "index columns", TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "levels of each index column", TypeConverters.toListInt)
    outputCol = Param(Params._dummy(), "outputCol", "feature vector column", TypeConverters.toString)

    def __init__(self, numCols=None, idxCols=None, sizes=None, outputCol="features"):
        super().__init__()
        self._set(numCols=list(numCols or []), idxCols=list(idxCols or []), sizes=list(sizes or []), outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        nums, idxs, sizes = g(self.numCols), g(self.idxCols), np.array(g(self.sizes), np.int64)
        begins = len(nums) + np.concatenate([[0], np.cumsum(sizes)])[:-1]
        width = int(len(nums) + sizes.sum())

        @F.arrow_udf(VectorUDT())
        def assemble(num: pa.Array, idx: pa.Array) -> pa.Array:
            n = len(num)
            x = num.flatten().to_numpy(zero_copy_only=False).reshape(n, len(nums))
            at = idx.flatten().to_numpy(zero_copy_only=False).reshape(n, len(sizes))
            where = np.hstack([np.tile(np.arange(len(nums)), (n, 1)), at + begins]).astype(np.int32)
            values = np.hstack([x, np.ones((n, len(sizes)))])
            keep = np.hstack([x != 0, at < sizes])
            offsets = pa.array(np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32))
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)),
                     pa.ListArray.from_arrays(offsets, pa.array(where[keep])), pa.ListArray.from_arrays(offsets, pa.array(values[keep]))]
            return pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])

        def listed(cols: list[str], kind: str):
            return F.array(*[F.col(f"`{c}`").cast(kind) for c in cols]) if cols else F.expr(f"cast(array() as array<{kind}>)")

        return df.withColumn(g(self.outputCol), assemble(listed(nums, "double"), listed(idxs, "bigint")))
