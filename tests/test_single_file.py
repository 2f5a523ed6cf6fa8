import os

import pytest
from pyspark.sql import functions as F

from tessera.sinks import write_results_csv


def table(spark, n=5000, parts=7):
    return spark.range(n, numPartitions=parts).select(
        F.col("id").alias("k"), F.when(F.col("id") % 5 != 0, F.concat(F.lit('a "b",\n '), F.col("id"))).alias("odd, \"name\""),
        (F.col("id") % 2 == 0).alias("even"))


def files(path):
    return sorted(f for f in os.listdir(path) if not f.startswith((".", "_")))


def test_one_file_in_row_order(spark, tmp_path):
    one, parts = str(tmp_path / "one"), str(tmp_path / "parts")
    write_results_csv(table(spark), one, single_file=True)
    write_results_csv(table(spark), parts)
    assert files(one) == ["part-00000.csv"] and len(files(parts)) == 7
    assert sorted(os.listdir(tmp_path)) == ["one", "parts"]
    whole = open(f"{one}/part-00000.csv", newline="").read()
    texts = [open(f"{parts}/{f}", newline="").read() for f in files(parts)]
    header = texts[0][:texts[0].index("even") + 5]
    assert whole == header + "".join(t[len(header):] for t in texts)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(one)
    assert [int(r["k"]) for r in back.collect()] == list(range(5000))


def test_no_task_writes_the_whole(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-file", "one file")
    write_results_csv(table(spark), str(tmp_path / "one"), single_file=True)
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("one-file")]
    spark.sparkContext.setJobGroup("", "")
    sizes = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert 7 in sizes and sizes.count(1) <= 1  # the header alone


def test_empty_tables_and_modes(spark, tmp_path):
    path = str(tmp_path / "one")
    write_results_csv(table(spark).limit(0), path, single_file=True)
    assert open(f"{path}/part-00000.csv").read().count("even") == 1
    write_results_csv(table(spark, 10), path, single_file=True, mode="ignore")
    assert os.path.getsize(f"{path}/part-00000.csv") < 40
    with pytest.raises(FileExistsError):
        write_results_csv(table(spark, 10), path, single_file=True, mode="error")
    with pytest.raises(ValueError, match="append"):
        write_results_csv(table(spark, 10), path, single_file=True, mode="append")
    write_results_csv(table(spark, 10), path, single_file=True)
    assert open(f"{path}/part-00000.csv").read().count("true") + open(f"{path}/part-00000.csv").read().count("True") == 5
