"""Distances to centroids: by Arrow batch as by hand, and stored once for the statistics over them."""

import math

import pytest
from conftest import SF_SMALL

from fairlease.operators import anomaly
from fairlease.plans import catalog, valuation

CENTERS = [[0.0, 0.0], [3.0, 4.0], [3.0, 4.0], [-1.0, 2.0]]
ROWS = [(0, [0.1, 0.2]), (1, [3.0, 4.0]), (2, [-1.5, 2.5]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [math.nan, 1.0]), (7, [1.0, 2.0, 3.0])]


def test_nearest_centroid_by_hand(spark):
    df = spark.createDataFrame(ROWS, "id int, v array<double>")
    got = {r["id"]: (r["cluster"], r["d"]) for r in anomaly.centroid_distance(df, CENTERS, "v", None, "d").collect()}
    for i, v in ROWS[:3]:
        want = [math.dist(v, c) for c in CENTERS]
        assert got[i] == (want.index(min(want)), pytest.approx(min(want), rel=1e-14))
    assert [got[i] for i in (3, 4, 5, 7)] == [(0, None)] * 4 and got[6][0] == 0 and math.isnan(got[6][1])
    own = anomaly.centroid_distance(df.selectExpr("*", "id % 4 c").where("id < 4"), CENTERS, "v", "c", "d")
    assert [r["d"] and round(r["d"], 9) for r in own.orderBy("id").collect()] == [round(math.dist(ROWS[0][1], CENTERS[0]), 9), 0.0, round(math.dist(ROWS[2][1], CENTERS[2]), 9), None]
    assert anomaly.centroid_distance(df.where("id < 0"), CENTERS, "v").collect() == []


def test_distances_are_stored_before_their_statistics(spark, monkeypatch):
    plans, robust_z = [], anomaly.robust_z

    def record(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower())
        return robust_z(df, *args, **kwargs)

    monkeypatch.setattr(anomaly, "robust_z", record)
    valuation.fit_artifacts(catalog._model_rows(spark, SF_SMALL), k=3, restarts=1, trees=5, spec={"kind": "rf", "numTrees": 2})
    catalog.REGISTRY["unsupervised_features"][0](spark, SF_SMALL)
    assert len(plans) == 2 and all("relation" in p and "join" not in p and "udf" not in p and "zip_with" not in p and "transform" not in p for p in plans)
