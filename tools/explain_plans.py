"""Write PLANS.md: the physical plans of the operators that carry the data work.

Usage: python tools/explain_plans.py [sf_dir]   (default /root/testdata/sf0.01)

Each section shows ``explain("formatted")`` of one representative DataFrame,
trimmed to the operator tree and the scan details, so a reader can check that
filters and projections reach the scan, that aggregations are partial + final,
and which side of each join is broadcast.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    keep = []
    for line in text.splitlines():
        if line.startswith(("Output", "Arguments", "Input")) and len(line) > 160:
            line = line[:160] + " ..."
        keep.append(line.rstrip())
    return "\n".join(keep).strip()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import functions as F

    from tessera.operators import metrics, stats
    from tessera.operators.split import split_hash, with_row_key
    from tessera.plans import views as V
    from tessera.plans.tasks import run_task
    from tessera.session import get_spark
    from tessera.sources.parquet import read_table

    spark = get_spark()
    li = V.lineitem_nulls(spark, sf)
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    keyed = with_row_key(read_table(spark, sf, "lineitem", V.LINEITEM_KEY), V.LINEITEM_KEY)
    hashed = keyed.withColumn("_h", split_hash("row_key", 42))
    probe = spark.createDataFrame([(1, 0, 20.0, 30.0, True, True)],
                                  "ci int, p int, lo double, hi double, exact boolean, count_below boolean")
    long = stats.long_numeric(li, cols)
    selection = (long.where(F.col("v").isNotNull()).join(F.broadcast(probe), "ci")
                 .where(F.col("v").between(F.col("lo"), F.col("hi")) | (F.col("v") < F.col("lo")))
                 .groupBy("p", F.col("v").alias("b")).agg(F.count(F.lit(1)).alias("n")))
    res = run_task(V.lineitem_reg(spark, sf), "Regression", "Ridge Regression", "net",
                   key_cols=V.LINEITEM_KEY, exclude=V.LINEITEM_KEY)
    ev = read_table(spark, sf, "events", ["event_id", "value", "user_id"])
    anomaly = run_task(ev, "Anomaly Detection", "Isolation Forest", None, key_cols=["event_id"], exclude=["event_id"])

    sections = [
        ("Parquet scan with a filter and a projection (pushdown, pruning)",
         read_table(spark, sf, "lineitem").where(F.col("l_quantity") > 10).select("l_tax")),
        ("Numeric summary: unpivot + grouped partial/final aggregate with a percentile sketch",
         long.groupBy("ci").agg(F.count("v"), F.min("v"), F.max("v"), F.avg("v"), F.var_pop("v"),
                                F.percentile_approx("v", [0.4985, 0.5015], 2000))),
        ("Exact selection pass: unpivot joined to the broadcast probe table", selection),
        ("Modes / dictionaries: value counts with map-side combine",
         stats.modes_frame(stats.value_counts_long(li, ["l_returnflag", "l_linestatus"]))),
        ("Split cut histogram over hash prefixes",
         hashed.groupBy(F.substring("_h", 1, 3).alias("b")).agg(F.count(F.lit(1)).alias("n"))),
        ("Split flag (no shuffle beyond the scan)", hashed.withColumn("is_test", F.col("_h") <= F.lit("8"))),
        ("Predictions of a fitted task (read from the cached split, no shuffle)", res.results),
        ("Regression metrics over the predictions", metrics.regression_metrics(res.results)),
        ("Isolation-forest scoring (Arrow-batched pandas UDF)", anomaly.results),
    ]
    out = ["# PLANS — physical plans of the data-carrying operators", "",
           f"Generated by `tools/explain_plans.py` on `{sf}` (`local[8]`, AQE on; the Exchange above each small",
           "scan is the row-index balancing of single-row-group files, absent when a scan has enough splits).", ""]
    for title, df in sections:
        out += [f"## {title}", "", "```", formatted(df), "```", ""]
    res.release()
    anomaly.release()
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
