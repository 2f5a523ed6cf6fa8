"""The first rows of a table in the order of its files."""
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.profile import first_rows, head_csv, preview
from tessera.sources import read_csv


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Rows whose ids are in no order; nine files of 50 rows, two of them empty."""
    ids = random.Random(4).sample(range(10_000), 450)
    folder = tmp_path_factory.mktemp("rows")
    at = 0
    for part in range(11):
        own = [] if part in (0, 4) else ids[at:at + 50]
        at += len(own)
        df = spark.createDataFrame([(i, f"t{i}") for i in own], "id long, t string").coalesce(1)
        df.write.parquet(f"{folder}/p/part={part:02d}")
        (folder / "c").mkdir(exist_ok=True)
        (folder / "c" / f"f{part:02d}.csv").write_text("id,t\n" + "".join(f"{i},t{i}\n" for i in own))
    return ids, str(folder)


@pytest.mark.parametrize("n", [1, 50, 51, 449, 450, 1000])
def test_parquet_in_file_order(spark, tables, n):
    ids, folder = tables
    df = spark.read.parquet(folder + "/p").drop("part")
    for same in (df, df.repartition(7), df.select("t", "id").where("id >= 0")):
        assert [r["id"] for r in first_rows(same, n).collect()] == ids[:n]


def test_only_the_first_files_are_read(spark, tables, tmp_path):
    ids, folder = tables
    spark.read.parquet(folder + "/p").where("part <= 2").select("id").coalesce(1).write.parquet(str(tmp_path / "a b=%c"))
    for k in range(6):
        (tmp_path / f"b{k}").mkdir()
        (tmp_path / f"b{k}" / "x.parquet").write_text("no Parquet file, reading it fails")
    df = spark.read.schema("id long").option("recursiveFileLookup", True).parquet(str(tmp_path))
    assert first_rows(df, 60).count() == 60
    with pytest.raises(Exception, match="FAILED_READ_FILE|Parquet"):
        df.count()


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_csv_in_file_order(spark, tables, split):
    ids, folder = tables
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        df = spark.read.option("header", True).schema("id long, t string").csv(folder + "/c")
        assert [r["id"] for r in first_rows(df, 120).collect()] == ids[:120]
        lines = [r["line"] for r in head_csv(df, 12).orderBy("line_no").collect()]
        assert lines == ["id,t"] + [f"{i},t{i}" for i in ids[:12]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_inferred_csv(spark, tables):
    ids, folder = tables
    assert [r["t"] for r in preview(read_csv(spark, folder + "/c/f01.csv"), 30).collect()] == [f"t{i}" for i in ids[:30]]


def test_without_files(spark):
    df = spark.range(5).withColumn("_metadata", F.lit(1))
    assert first_rows(df, 3).count() == 3 and first_rows(spark.range(5), 9).count() == 5
    assert first_rows(spark.range(5).groupBy("id").count(), 2).count() == 2


def test_derived_frames_keep_their_rows(spark, tables):
    """A frame over files that is not a plain scan: the rows are its own, whatever their order."""
    df = spark.read.parquet(tables[1] + "/p").select((F.col("id") % 5).alias("k"))
    for d in (df.distinct(), df.dropDuplicates(["k"]), df.groupBy("k").count().drop("count")):
        assert sorted(r["k"] for r in first_rows(d, 50).collect()) == [0, 1, 2, 3, 4]
    assert first_rows(df.limit(7), 50).count() == 7 and first_rows(df.union(df), 2000).count() == 900
