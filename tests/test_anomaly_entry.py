import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fairlease.operators import anomaly


def test_isolation_forest_ranks_outliers_high(spark):
    rng = np.random.default_rng(6)
    pts = rng.normal(size=(600, 3)).tolist() + [[8.0, 8.0, 8.0], [-9.0, 7.0, 9.0]]
    df = spark.createDataFrame([(str(i), Vectors.dense(p)) for i, p in enumerate(pts)], ["row_key", "features"])
    model = anomaly.fit_isolation_forest(df, "features", "row_key", n_trees=50, psi=128, contamination=None)
    s = {r["row_key"]: r["isolation_score"] for r in model.score_frame(df, "features").collect()}
    inliers = sorted(v for k, v in s.items() if int(k) < 600)
    assert s["600"] > inliers[-10] and s["601"] > inliers[-10]
    assert all(0 < v < 1 for v in s.values())


def test_robust_z_small_cluster_uses_global(spark):
    rows = [(0, float(d)) for d in np.linspace(1, 2, 50)] + [(1, 10.0), (1, 11.0)]
    df = spark.createDataFrame(rows, "cluster int, d double")
    _, st = anomaly.robust_z(df, "cluster", "d", min_rows=30)
    flags = {r["cluster"]: r["used_global_fallback"] for r in st.collect()}
    assert flags == {0: False, 1: True}


def test_entry_and_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert all(isinstance(v, str) for v in o.values())


def test_isolation_offset_marks_contamination_share(spark):
    rng = np.random.default_rng(10)
    pts = rng.normal(size=(1000, 2)).tolist()
    df = spark.createDataFrame([(str(i), Vectors.dense(p)) for i, p in enumerate(pts)], ["row_key", "features"])
    model = anomaly.fit_isolation_forest(df, "features", "row_key", n_trees=60, psi=128, contamination=0.05)
    scores = [r["isolation_score"] for r in model.score_frame(df, "features").collect()]
    share = sum(s > 0 for s in scores) / len(scores)
    assert share == pytest.approx(0.05, abs=0.01)
