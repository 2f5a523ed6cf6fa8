"""Sinks (K1-K3): results as CSV, the report as JSON, the fitted model.

All writers are distributed: the results table is written as part files by the
executors (asked for a single file, the file system joins the parts, no task
writes the whole), the report is one small JSON document, and the model is a ``PipelineModel`` folder that
``load_model`` reads back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import as_text


def write_results_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """K1: header row, no index; cells in the reference's text form (True/False, plain numbers). Text is
    written as it is, outer blanks and line breaks (inside quotes) included.

    ``single_file`` leaves one file ``part-00000.csv`` in the folder ``path``: the executors write parts
    without a header beside it, which are joined in their order behind one header. An empty table gives
    the header alone. A folder that exists is replaced, kept or refused as ``mode`` says, after the parts
    are written; appending to a single file is refused.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    out = df.select(*[as_text(F.col(f"`{c}`"), types[c]).alias(c) for c in df.columns])
    if not single_file:
        _csv(out, True).mode(mode).csv(path)
        return
    spark = df.sparkSession
    fs, folder = _file_system(spark, path)
    modes = {"overwrite", "ignore", "error", "errorifexists"}
    if mode not in modes:
        raise ValueError(f"A single file cannot be written with mode {mode!r}; choose one of {sorted(modes)}.")
    if mode != "overwrite" and fs.exists(folder):
        if mode == "ignore":
            return
        raise FileExistsError(f"Path {path} already exists.")
    parts = f"{path.rstrip('/')}__parts_{uuid.uuid4().hex}"
    try:
        empty = spark.createDataFrame([], out.schema).coalesce(1)
        _csv(empty, True).csv(f"{parts}/header")
        _csv(out, False).csv(f"{parts}/rows")
        _join_files(spark, [f"{parts}/header", f"{parts}/rows"], path)
    finally:
        fs.delete(_path(spark, parts), True)


def _csv(df: DataFrame, header: bool) -> DataFrameWriter:
    return (df.write.option("header", header).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False))


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    folder = _path(spark, path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _join_files(spark: SparkSession, folders: list[str], path: str) -> None:
    """One file ``path/part-00000.csv`` of the part files of ``folders``, in order. A file system that can
    concatenate does so by its block lists, without moving a byte; on others the parts are appended one
    after the other through a buffer of fixed size."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, folder = _file_system(spark, path)
    found = []
    for f in folders:
        names = [s.getPath() for s in fs.listStatus(_path(spark, f)) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
        found += sorted(names, key=lambda p: p.getName())
    fs.delete(folder, True)
    fs.mkdirs(folder)
    target = jvm.org.apache.hadoop.fs.Path(folder, "part-00000.csv")
    if not found:  # a table without columns
        fs.create(target).close()
        return
    if fs.hasPathCapability(found[0], "fs.capability.paths.concat"):
        # files to be joined must lie in one folder
        moved = [jvm.org.apache.hadoop.fs.Path(folder, f"_{i:08d}") for i in range(len(found))]
        more = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(found) - 1)
        for i, (p, q) in enumerate(zip(found, moved)):
            fs.rename(p, q)
            if i:
                more[i - 1] = q
        if len(more):
            fs.concat(moved[0], more)
        fs.rename(moved[0], target)
        return
    sink = fs.create(target, True)
    try:
        for p in found:
            source = fs.open(p)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, sink, conf, False)
            finally:
                source.close()
    finally:
        sink.close()


def report_document(report: dict) -> str:
    """K2 text: ``json.dumps(indent=2)``; int keys become strings, like the reference."""
    return json.dumps(report, indent=2, default=_plain)


def _plain(v):
    try:
        import numpy as np

        if isinstance(v, np.generic):
            return v.item()
        if isinstance(v, np.ndarray):
            return v.tolist()
    except ImportError:  # pragma: no cover
        pass
    return str(v)


def write_report_json(spark: SparkSession, report: dict, path: str, mode: str = "overwrite") -> None:
    """K2: one JSON document in a one-row text table (works on any shared filesystem)."""
    spark.createDataFrame([(report_document(report),)], "value string").coalesce(1).write.mode(mode).text(path)


def read_report_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.option("wholetext", True).text(path).collect()
    return json.loads("".join(r["value"] for r in rows))


def save_model(model: PipelineModel, path: str) -> None:
    """K3: the full fitted pipeline (preprocessing and model), overwriting."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
