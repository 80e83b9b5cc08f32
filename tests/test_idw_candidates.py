"""IDW positions by candidates equal those by all distances; k-means passes are split over tasks."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fairlease.operators import anomaly


def test_candidates_give_the_positions_of_all_distances():
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 6, (600, 3)) / 4.0
    rows = {"plain": rng.normal(size=(300, 3)), "grid": rng.integers(0, 6, (300, 3)) / 4.0, "far": rng.normal(size=(50, 3)) + 1e6, "gaps": np.where(rng.random((50, 3)) < 0.1, np.nan, 1.0)}
    for ref in (rng.normal(size=(600, 3)), np.repeat(rng.normal(size=(30, 3)), 20, 0), grid, grid + 1e6):
        xy = ref[:, :2] * [1.5, 2.5] + ref[:, 2:]
        for name, x in rows.items():
            assert np.allclose(anomaly._idw_near(x, ref, xy, 12), anomaly._idw(x, ref, xy, 12), rtol=1e-9, equal_nan=True), name


def test_most_rows_need_no_distance_to_every_point(spark, monkeypatch):
    rng = np.random.default_rng(2)
    ref, x, asked, every = rng.normal(size=(500, 3)), rng.normal(size=(200, 3)), [], anomaly._idw
    monkeypatch.setattr(anomaly, "_idw", lambda x, *a: asked.append(len(x)) or every(x, *a))
    anomaly._idw_near(x, ref, ref[:, :2], 12)
    assert sum(asked) < 20
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, a array<double>").select("id", array_to_vector("a").alias("features"))
    got = {r["id"]: (r["cluster_x"], r["cluster_y"]) for r in anomaly.idw_project(df, "features", ref, ref[:, :2]).collect()}
    assert np.allclose([got[i] for i in range(len(x))], every(x, ref, ref[:, :2], 12))
    assert anomaly.idw_project(df, "features", np.zeros((0, 3)), np.zeros((0, 2))).where(F.isnan("cluster_x") & F.isnan("cluster_y")).count() == len(x)


def test_a_pass_of_kmeans_takes_several_tasks(spark, monkeypatch):
    df = spark.range(3000).select(F.array((F.col("id") % 60).cast("double"), (F.col("id") / 7).cast("double")).alias("features"))
    whole, parts, sums = anomaly.fit_kmeans(df, 4, 3), [], anomaly._sums
    monkeypatch.setattr(anomaly, "_sums", lambda points, centers: parts.append(points.rdd.getNumPartitions()) or sums(points, centers))
    monkeypatch.setattr(anomaly, "POINTS_PER_TASK", 500)
    split = anomaly.fit_kmeans(df, 4, 3)
    assert set(parts) == {4} and np.allclose(whole.cost, split.cost) and np.allclose(whole.centers, split.centers)
