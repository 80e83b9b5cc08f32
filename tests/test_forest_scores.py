"""Scores of the isolation forest against a walk of every tree."""

import numpy as np
from pyspark.ml.functions import array_to_vector

from fairlease.operators import anomaly


def test_forest_scores_by_walking_every_tree(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)).round(1)
    x[5, 1] = np.nan
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "k string, a array<double>").withColumn("v", array_to_vector("a"))
    forest = anomaly.fit_isolation_forest(df.where("k <> '5'"), "v", "k", n_trees=8, psi=32)
    nodes = {(r.tree, r.node): r for r in forest.nodes.itertuples()}
    trees = sorted({t for t, _ in nodes})

    def depth(tree, row):
        at = nodes[tree, 0]
        while at.feature >= 0:
            at = nodes[tree, at.left if row[at.feature] < at.threshold else at.right]
        return at.depth + float(anomaly._c_factor(np.array([at.size]))[0])

    c = float(anomaly._c_factor(np.array([forest.psi]))[0])
    got = {r["k"]: r["isolation_score"] for r in forest.score_frame(df, "v").collect()}
    for i, row in enumerate(x):
        want = 2.0 ** (-np.mean([depth(t, row) for t in trees]) / c) + forest.offset
        assert abs(got[str(i)] - want) < 1e-12
