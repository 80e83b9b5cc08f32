"""Learners are fitted on stored vectors; fits on the same rows share them."""

from fairlease.operators import models


def test_vectors_keep_their_attributes(spark):
    df = spark.createDataFrame([(str(i % 3), float(i), float(i)) for i in range(30)], "c string, x double, target double")
    ready = models.prepare(df, None, ["c"], ["x"], {"kind": "rf"})
    assert ready.data.schema["features"].metadata["ml_attr"]["num_attrs"] == 2


def test_fits_on_the_same_rows_share_a_design(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), str(i % 3), float(i), float(i)) for i in range(60)], "row_key string, c string, x double, target double")
    made, prepare = [], models.prepare
    monkeypatch.setattr(models, "prepare", lambda *a, **k: made.append(1) or prepare(*a, **k))
    train, valid = df.where("x % 4 <> 0"), df.where("x % 4 = 0")
    _, trials = models.tune(train, valid, ["c"], ["x"], {"maxDepth": ("int", 1, 2)}, n_trials=3, base={"kind": "gbt", "maxIter": 2})
    assert len(made) == 1 and [r["trial"] for r in trials.orderBy("trial").collect()] == [0, 1, 2]
    specs = {"a": {"kind": "rf", "numTrees": 2}, "b": {"kind": "gbt", "maxIter": 2}}
    fitted, failed = models.train_tree_models(df.where("x % 3 <> 0"), valid, ["c"], ["x"], specs)
    assert len(made) == 2 and list(fitted) == ["a", "b"] and not failed
    assert models.prepare(train, valid, ["c"], ["x"], specs["a"]).data.rdd.getNumPartitions() == 1


def test_a_tree_design_asks_for_medians_alone(spark):
    df = spark.createDataFrame([(float(i), None if i % 2 else float(i)) for i in range(9)], "x double, y double")
    assert models.tree_design([], ["x", "y"]).numeric_stats(df) == {"x": (4.0, 0.0, 1.0), "y": (4.0, 0.0, 1.0)}
    fitted = models.tree_design([], ["x", "y"]).fit(df).transform(df)
    assert [r["features"].tolist() for r in fitted.where("x < 2").orderBy("x").collect()] == [[0.0, 0.0], [1.0, 4.0]]
