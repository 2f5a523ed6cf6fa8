"""Preprocessing (M0, F1-F5): median/mode fill, population z-score, one-hot, assembly.

``TabularPreprocessor.fit`` runs the fused statistics of ``stats`` (one numeric
aggregate, a few tiny selection passes for exact medians, one grouped value
count for modes and dictionaries) and returns a ``PipelineModel`` of

    ImputeScaleModel -> StringIndexerModel -> OneHotEncoderModel -> VectorAssembler

or, where the dictionaries are too large for the driver (``stats.DRIVER_LEVELS``),

    ImputeScaleModel -> StringIndexerModel of the small ones -> DictionaryIndexer -> SparseAssembler

The dictionaries are handed to ``StringIndexerModel.from_labels``
(sorted ascending, unseen values -> the extra last index), and ``dropLast=True``
drops exactly that extra slot, so each real level keeps a column and an unseen
value encodes to all zeros. All-null columns are dropped, as in the reference.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import categorical_columns, numeric_columns
from tessera.operators import stats
from tessera.operators.dictionary import DictionaryIndexer, SparseAssembler
from tessera.operators.stages import ImputeScaleModel


@dataclass
class PrepInfo:
    num_cols: list[str]
    cat_cols: list[str]
    dropped: list[str]
    medians: dict
    means: dict
    stds: dict
    modes: dict
    categories: dict  # of the columns held on the driver
    rows: int
    width: int  # features after encoding
    feature_names: list[str] | None  # None where dictionaries are not held on the driver
    mean_variance: float = 1.0  # mean per-feature variance of the encoded matrix
    feature_means: list[float] | None = field(default_factory=list)  # of the encoded matrix, None as above
    dictionary: DataFrame | None = None  # (position, column, value, idx)
    begins: dict[str, int] = field(default_factory=dict)  # first feature of each categorical column

    def features(self, spark: SparkSession) -> DataFrame:
        """``(i, feature)``: number and name of every feature."""
        held = [(i, c) for i, c in enumerate(self.num_cols)]
        held += [(self.begins[c] + k, f"{c}_{v}") for c in self.cat_cols if c in self.categories for k, v in enumerate(self.categories[c])]
        out = spark.createDataFrame(held, "i long, feature string")
        if self.dictionary is None:
            return out
        joined = [(c, self.begins[c]) for c in self.cat_cols if c not in self.categories]
        begins = spark.createDataFrame(joined, "column string, begin long")
        names = self.dictionary.join(F.broadcast(begins), "column")
        return out.union(names.select(F.col("begin") + F.col("idx"), F.concat_ws("_", "column", "value")))


def split_roles(df: DataFrame, features: list[str] | None = None, exclude: tuple[str, ...] = ()) -> tuple[list, list]:
    """Numeric vs categorical columns among the features (schema only)."""
    cols = features if features is not None else [c for c in df.columns if c not in exclude]
    sub = df.select(*[f"`{c}`" for c in cols])
    return numeric_columns(sub), categorical_columns(sub)


def fit_statistics(df: DataFrame, num_cols: list[str], cat_cols: list[str], driver_levels: int | None = None):
    summary = stats.numeric_summary(df, num_cols)
    medians = stats.exact_medians(df, num_cols, summary) if num_cols else {}
    means, stds = stats.imputed_moments(summary, medians)
    cstats = stats.category_stats(df, cat_cols, driver_levels=driver_levels)
    return summary, medians, means, stds, cstats


class TabularPreprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator whose fit returns the preprocessing ``PipelineModel``."""

    numCols = Param(Params._dummy(), "numCols", "numeric feature columns", TypeConverters.toListString)
    catCols = Param(Params._dummy(), "catCols", "categorical feature columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "feature vector column", TypeConverters.toString)

    driverLevels = Param(Params._dummy(), "driverLevels", "levels of all dictionaries that the driver holds", TypeConverters.toInt)

    def __init__(self, numCols=None, catCols=None, outputCol="features", driverLevels=None):
        super().__init__()
        levels = stats.DRIVER_LEVELS if driverLevels is None else driverLevels
        self._set(numCols=list(numCols or []), catCols=list(catCols or []), outputCol=outputCol, driverLevels=levels)
        self.info: PrepInfo | None = None

    def _fit(self, df: DataFrame) -> PipelineModel:
        num_cols, cat_cols = self.getOrDefault(self.numCols), self.getOrDefault(self.catCols)
        summary, medians, means, stds, cstats = fit_statistics(df, num_cols, cat_cols, self.getOrDefault(self.driverLevels))
        keep_num = [c for c in num_cols if medians.get(c) is not None]
        keep_cat = [c for c in cat_cols if cstats.mode.get(c) is not None]
        dropped = [c for c in num_cols + cat_cols if c not in keep_num + keep_cat]
        width = len(keep_num) + sum(cstats.n_distinct[c] for c in keep_cat)
        if width == 0:
            raise ValueError("No usable feature columns (all are empty).")
        impute = ImputeScaleModel(numCols=keep_num, medians=[medians[c] for c in keep_num],
                                  means=[means[c] for c in keep_num], stds=[stds[c] for c in keep_num],
                                  catCols=keep_cat, modes=[cstats.mode[c] for c in keep_cat])
        held = [c for c in keep_cat if c in cstats.categories]
        sizes = [cstats.n_distinct[c] for c in keep_cat]
        begins = {c: len(keep_num) + sum(sizes[:i]) for i, c in enumerate(keep_cat)}
        cat_out = dict(zip(keep_cat, impute.catOutputCols()))
        idx_out = {c: f"__idx_{i}" for i, c in enumerate(keep_cat)}
        # one indexer per column: the multi-column form pads shorter label lists with nulls
        indexers = [StringIndexerModel.from_labels(cstats.categories[c], inputCol=cat_out[c], outputCol=idx_out[c],
                                                   handleInvalid="keep") for c in held]
        stages = [impute, *indexers]
        output = self.getOrDefault(self.outputCol)
        names = list(keep_num) + [f"{c}_{v}" for c in keep_cat for v in cstats.categories[c]] if len(held) == len(keep_cat) else None
        if names is None or any("" in cstats.categories[c] for c in held):  # the library's encoder takes no empty level
            joined = [c for c in keep_cat if c not in held]
            if joined:
                stages.append(DictionaryIndexer([cat_out[c] for c in joined], [idx_out[c] for c in joined], [cstats.positions[c] for c in joined],
                                                [cstats.n_distinct[c] for c in joined], cstats.dictionary))
            stages.append(SparseAssembler(impute.numOutputCols(), [idx_out[c] for c in keep_cat], sizes, output))
        else:
            inputs = impute.numOutputCols()
            if keep_cat:
                ohe_out = [f"__ohe_{i}" for i in range(len(keep_cat))]
                encoded = impute.transform(df.limit(0))
                for ix in indexers:
                    encoded = ix.transform(encoded)
                ohe = OneHotEncoder(inputCols=list(idx_out.values()), outputCols=ohe_out, dropLast=True, handleInvalid="error").fit(encoded)
                stages.append(ohe)
                inputs += ohe_out
            stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error"))
        n = max(summary.rows, 1)
        variance = float(sum(stds[c] > 0 for c in keep_num))
        shares: list[float] | None = [0.0] * len(keep_num)
        for c in keep_cat:
            if c in held:
                filled = dict(cstats.counts[c])
                filled[cstats.mode[c]] += n - sum(filled.values())  # nulls take the mode
                shares += [filled[v] / n for v in cstats.categories[c]]
                variance += sum((filled[v] / n) * (1 - filled[v] / n) for v in cstats.categories[c])
            else:
                values, most, squares = cstats.filled[c]
                variance += 1 - (squares - most ** 2 + (most + n - values) ** 2) / n ** 2
        self.info = PrepInfo(keep_num, keep_cat, dropped, medians, means, stds, cstats.mode, {c: cstats.categories[c] for c in held}, summary.rows,
                             width, names, variance / width, shares if names is not None else None, cstats.dictionary, begins)
        return PipelineModel(stages)


def fit_preprocessor(df: DataFrame, num_cols: list[str], cat_cols: list[str],
                     output_col: str = "features", driver_levels: int | None = None) -> tuple[PipelineModel, PrepInfo]:
    est = TabularPreprocessor(numCols=num_cols, catCols=cat_cols, outputCol=output_col, driverLevels=driver_levels)
    model = est.fit(df)
    return model, est.info
