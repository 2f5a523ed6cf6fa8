"""Small fitted ``pyspark.ml`` stages (Transformers) whose state is a few numbers.

They are plain column projections, so they fuse into the surrounding
whole-stage-codegen span and persist with ``DefaultParamsWritable``.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import as_text, num_value, zscore


def _c(name: str):
    return F.col(f"`{name}`")


class ImputeScaleModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Median fill + population z-score for numeric columns, mode fill for categorical ones.

    Numeric output ``__num_i`` = (coalesce(x, median) - mean) / std (std 0 -> 1);
    categorical output ``__cat_i`` = coalesce(text(x), mode).
    """

    numCols = Param(Params._dummy(), "numCols", "numeric input columns", TypeConverters.toListString)
    medians = Param(Params._dummy(), "medians", "fill value per numeric column", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean after filling", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population std after filling", TypeConverters.toListFloat)
    catCols = Param(Params._dummy(), "catCols", "categorical input columns", TypeConverters.toListString)
    modes = Param(Params._dummy(), "modes", "fill value per categorical column", TypeConverters.toListString)

    def __init__(self, numCols=None, medians=None, means=None, stds=None, catCols=None, modes=None):
        super().__init__()
        self._setDefault(numCols=[], medians=[], means=[], stds=[], catCols=[], modes=[])
        kw = {k: v for k, v in dict(numCols=numCols, medians=medians, means=means, stds=stds,
                                    catCols=catCols, modes=modes).items() if v is not None}
        self._set(**kw)

    def numOutputCols(self) -> list[str]:
        return [f"__num_{i}" for i in range(len(self.getOrDefault(self.numCols)))]

    def catOutputCols(self) -> list[str]:
        return [f"__cat_{i}" for i in range(len(self.getOrDefault(self.catCols)))]

    def _transform(self, df: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in df.schema.fields}
        out = {}
        g = self.getOrDefault
        for i, (c, med, mu, sd) in enumerate(zip(g(self.numCols), g(self.medians), g(self.means), g(self.stds))):
            out[f"__num_{i}"] = zscore(F.coalesce(num_value(_c(c)), F.lit(med)), mu, sd)
        for i, (c, mode) in enumerate(zip(g(self.catCols), g(self.modes))):
            out[f"__cat_{i}"] = F.coalesce(as_text(_c(c), types[c]), F.lit(mode))
        return df.withColumns(out) if out else df


class CopyColumn(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``outputCol = inputCol``; a column of the output's name is replaced."""

    inputCol = Param(Params._dummy(), "inputCol", "column to copy", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "its new name", TypeConverters.toString)

    def __init__(self, inputCol="__prediction", outputCol="y_pred"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOrDefault(self.outputCol), _c(self.getOrDefault(self.inputCol)))


class IndexMap(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``outputCol = mapping[int(inputCol)]`` (e.g. deterministic cluster numbering)."""

    inputCol = Param(Params._dummy(), "inputCol", "input index column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output column", TypeConverters.toString)
    mapping = Param(Params._dummy(), "mapping", "new index for each old index", TypeConverters.toListInt)

    def __init__(self, inputCol="prediction", outputCol="cluster", mapping=None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, mapping=list(mapping or []))

    def _transform(self, df: DataFrame) -> DataFrame:
        arr = F.array(*[F.lit(int(m)) for m in self.getOrDefault(self.mapping)])
        idx = _c(self.getOrDefault(self.inputCol)).cast("int")
        return df.withColumn(self.getOrDefault(self.outputCol), F.element_at(arr, idx + 1))


class PCScores(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Centred, sign-fixed component scores from an uncentred projection vector.

    ``pc_j = sign_j * (proj_j - offset_j)`` with ``offset_j = mean . v_j``.
    """

    inputCol = Param(Params._dummy(), "inputCol", "projection vector column", TypeConverters.toString)
    outputCols = Param(Params._dummy(), "outputCols", "score columns", TypeConverters.toListString)
    offsets = Param(Params._dummy(), "offsets", "mean . v_j", TypeConverters.toListFloat)
    signs = Param(Params._dummy(), "signs", "+1 / -1 per component", TypeConverters.toListFloat)

    def __init__(self, inputCol="pca_raw", outputCols=None, offsets=None, signs=None):
        super().__init__()
        self._set(inputCol=inputCol, outputCols=list(outputCols or ["pc1", "pc2"]),
                  offsets=list(offsets or []), signs=list(signs or []))

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        arr = vector_to_array(_c(self.getOrDefault(self.inputCol)))
        out = {}
        for j, (name, off, s) in enumerate(zip(self.getOrDefault(self.outputCols), self.getOrDefault(self.offsets),
                                                self.getOrDefault(self.signs))):
            out[name] = F.lit(s) * (arr[j] - F.lit(off))
        return df.withColumns(out)
