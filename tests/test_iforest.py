import numpy as np
import pandas as pd
from pyspark.ml.linalg import Vectors

from tessera.operators.iforest import IsolationForestModel, average_path_length, path_lengths, _forest_arrays
from tessera.plans.tasks import run_task


def test_average_path_length():
    c = average_path_length(np.array([0, 1, 2, 256]))
    assert c[0] == 0 and c[1] == 0 and c[2] == 1
    assert abs(c[3] - (2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)) < 1e-9


def test_hand_made_tree_path_lengths():
    # root splits feature 0 at 0.5; left leaf holds 3 rows at depth 1, right leaf 1 row at depth 1
    nodes = pd.DataFrame({"tree": [0, 0, 0], "node": [0, 1, 2], "left": [1, -1, -1], "right": [2, -1, -1],
                          "feature": [0, -1, -1], "threshold": [0.5, 0.0, 0.0], "size": [4, 3, 1], "depth": [0, 1, 1]})
    arr = _forest_arrays(nodes, 1)
    got = path_lengths(np.array([[0.1], [0.9]]), arr, 1)
    assert abs(got[0] - (1 + average_path_length(np.array([3]))[0])) < 1e-12
    assert got[1] == 1.0


def test_planted_outliers_rank_lowest(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(0, 1, (500, 2)).tolist() + [[20, 20], [-20, 20], [20, -20], [-20, -20], [25, 0]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, a double, b double")
    res = run_task(df, "Anomaly Detection", "Isolation Forest", None, key_cols=["id"], exclude=["id"])
    rows = res.results.orderBy("anomaly_score").collect()
    assert {r["id"] for r in rows[:5]} == {500, 501, 502, 503, 504}
    scores = [r["anomaly_score"] for r in rows]
    assert min(scores) >= -0.5 and max(scores) < 0.5
    assert res.report["anomalies"] == sum(1 for s in scores if s < 0)
    assert all(r["is_anomaly"] for r in rows[:5])
    hist = res.plot["data"].collect()
    assert len(hist) == 30 and sum(r["n"] for r in hist) == 505
    res.release()


def test_identical_rows_score_equally_and_rerun(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(0, 1, (300, 2)).tolist() + [[0.3, 0.3]] * 5
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, a double, b double")
    df = df.repartition(4, "id").sortWithinPartitions("id")
    outs = []
    for _ in range(2):
        res = run_task(df, "Anomaly Detection", "Isolation Forest", None, key_cols=["id"], exclude=["id"])
        outs.append({r["id"]: r["anomaly_score"] for r in res.results.collect()})
        res.release()
    dup = [outs[0][i] for i in range(300, 305)]
    assert max(dup) == min(dup)
    assert outs[0] == outs[1]


def test_iforest_model_save_load(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (200, 2)))],
                               "id long, a double, b double")
    res = run_task(df, "Anomaly Detection", "Isolation Forest", None, key_cols=["id"], exclude=["id"])
    forest = res.model.stages[-1]
    path = str(tmp_path / "forest")
    forest.write().overwrite().save(path)
    again = IsolationForestModel.load(path)
    probe = spark.createDataFrame([(Vectors.dense([0.0, 0.0]),), (Vectors.dense([5.0, 5.0]),)], ["__features"])
    a = [r["anomaly_score"] for r in forest.transform(probe).collect()]
    b = [r["anomaly_score"] for r in again.transform(probe).collect()]
    assert a == b and a[1] < a[0]
    res.release()
