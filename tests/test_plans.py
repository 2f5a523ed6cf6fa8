"""Plan-shape checks: the properties the scale design relies on, read from explain()."""

import contextlib
import io

from pyspark.sql import functions as F

from conftest import SF_MID
from tessera.plans import views as V
from tessera.plans.tasks import run_task
from tessera.sources.parquet import read_table


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_filters_push_down_and_columns_prune(spark):
    df = read_table(spark, SF_MID, "lineitem").where(F.col("l_quantity") > 10).select("l_tax")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in text
    schema_line = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "l_tax" in schema_line and "l_extendedprice" not in schema_line


def test_predictions_add_no_shuffle(spark):
    res = run_task(V.lineitem_reg(spark, SF_MID), "Regression", "Ridge Regression", "net",
                   key_cols=V.LINEITEM_KEY, exclude=V.LINEITEM_KEY)
    text = plan(res.results, "simple")
    top = text.split("InMemoryRelation")[0]  # the part above the cached split
    assert "Exchange" not in top and "Sort" not in top
    res.release()


def test_selection_pass_broadcasts_only_the_probe_table(spark, monkeypatch):
    from tessera.operators import stats

    seen = []
    cls = type(spark.range(1))  # the session's concrete DataFrame class
    real = cls.toPandas

    def spy(self):
        seen.append(plan(self, "simple"))
        return real(self)

    monkeypatch.setattr(cls, "toPandas", spy)
    df = V.lineitem_nulls(spark, SF_MID)
    stats.exact_medians(df, ["l_quantity", "l_extendedprice"])
    passes = [p for p in seen if "BroadcastHashJoin" in p]
    assert passes, "selection pass should join the probe table by broadcast"
    for p in passes:
        side = p.split("BroadcastExchange", 1)[1]
        # the broadcast side is the small probe table built on the driver, not a scan of the data
        assert "Scan ExistingRDD" in side or "LocalTableScan" in side
        assert "FileScan" not in side
