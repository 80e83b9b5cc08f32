"""Global samples and jitter, aligned predictions, failure-tolerant folds, plot layouts."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fairlease.operators import anomaly, ensemble, models, risk, splits


def test_global_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("row_key")).cache()
    for n in (0, 1, 700, 4999, 5000, 9000):
        got = {r["row_key"] for r in splits.sample_global(df, n, seed=7).collect()}
        assert len(got) == min(n, 5000)
        assert got == {r["row_key"] for r in splits.sample_global(df.repartition(7), n, seed=7).collect()}
    import hashlib

    want = sorted(map(str, range(5000)), key=lambda k: hashlib.md5(f"7|{k}".encode()).hexdigest())[:700]
    assert {r["row_key"] for r in splits.sample_global(df, 700, seed=7).collect()} == set(want)
    assert splits.sample_global(df.limit(0), 10).count() == 0


def test_jitter_is_normal_and_fixed(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    read = lambda salt, seed=42: np.array([r["z"] for r in df.select("k", splits.normal_jitter(["k"], salt, 2.0, seed).alias("z")).orderBy("k").collect()])
    z = read("a")
    assert abs(z.mean()) < 0.05 and abs(z.std() - 2) < 0.05 and abs(np.mean(np.abs(z) < 2) - 0.6827) < 0.015
    assert np.array_equal(z, read("a")) and abs(np.corrcoef(z, read("b"))[0, 1]) < 0.03 and not np.array_equal(z, read("a", 1))


def test_plot_points_keep_what_has_a_position(spark):
    rows = [(str(i), i % 2, float(i) if i % 5 else None, 1e8 * i if i % 7 else float("nan")) for i in range(200)]
    df = spark.createDataFrame(rows, "row_key string, c int, area_m2_clean double, rent_deposit_median double")
    got = splits.plot_points(df, "c", n=40).collect()
    assert 40 <= len(got) <= 80 and all(r["y"] >= 0 and np.isfinite([r["x"], r["y"]]).all() and r["cluster_id"] in ("0", "1") for r in got)


def sets(spark, a, b):
    schema = "row_key string, target double, pred_x double"
    return {"a": spark.createDataFrame(a, schema), "b": spark.createDataFrame(b, schema)}


def test_aligned_sets_and_names(spark):
    out = ensemble.align_predictions(sets(spark, [("1", 1.0, 0.1), ("2", None, 0.2), ("3", float("nan"), None)], [("3", None, 3.0), ("1", 1.0 + 1e-12, 1.1), ("2", None, 2.2)]))
    assert out.columns == ["row_key", "target", "pred_x", "pred_x_b"]
    assert {(r["row_key"], r["pred_x"], r["pred_x_b"]) for r in out.collect()} == {("1", 0.1, 1.1), ("2", 0.2, 2.2), ("3", None, 3.0)}
    assert ensemble.run_name(["pred_a", "b_pred", "c"]) == "a__b__c"


@pytest.mark.parametrize(
    "b, what",
    [
        ([("1", None, 1.1), ("2", 2.0, 2.2)], "different target"),
        ([("1", 1.0, 1.1), ("2", 2.5, 2.2)], "different target"),
        ([("1", 1.0, 1.1)], "same rows"),
        ([("1", 1.0, 1.1), ("2", 2.0, 2.2), ("9", 2.0, 2.2)], "same rows"),
        ([("1", 1.0, 1.1), ("2", 2.0, 2.2), ("2", 2.0, 2.3)], "more than once"),
    ],
)
def test_sets_that_do_not_fit(spark, b, what):
    with pytest.raises(ValueError, match=what):
        ensemble.align_predictions(sets(spark, [("1", 1.0, 0.1), ("2", 2.0, 0.2)], b))


def test_a_failing_spec_costs_only_itself(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(str(i), f"2020-{1 + i % 6:02d}", float(rng.normal()), str(i % 3)) for i in range(240)]
    df = spark.createDataFrame(rows, "row_key string, ym string, x double, c string").withColumn("target", F.col("x") * 2 + 1)
    folds = splits.month_folds(df, 3)
    good = {"kind": "rf", "maxDepth": 4, "numTrees": 5}
    fit = models.fit_model

    def fails_on_one_fold(train, valid, cat, num, spec, label="target", seed=42):
        if spec.get("broken") and train.where("fold = 0").isEmpty():
            raise RuntimeError("out of luck")
        return fit(train, valid, cat, num, {k: v for k, v in spec.items() if k != "broken"}, label, seed)

    monkeypatch.setattr(models, "fit_model", fails_on_one_fold)
    run = models.out_of_fold(df, folds, ["c"], ["x"], {"good": good, "bad": good | {"broken": True}})
    errors = {(r["fold"], r["model"]): r["error"] for r in run.outcomes.collect()}
    assert len(errors) == 6 and errors[0, "bad"] == "out of luck" and sum(e is not None for e in errors.values()) == 1
    assert [r["model"] for r in run.complete_models().collect()] == ["good"]
    kept = run.complete().collect()
    assert len(kept) == 240 and {r["model"] for r in kept} == {"good"}
    stored = run.predictions.toPandas()
    got = {(r["fold"], r["model"]): r for r in run.fold_metrics().collect()}
    for (fold, name), part in stored.groupby(["fold", "model"]):
        e = part["target"] - part["oof"]
        r = got[fold, name]
        assert r["n"] == len(part) and r["error"] is None
        assert np.allclose([r["rmse"], r["mae"], r["r2"]], [np.sqrt((e**2).mean()), e.abs().mean(), 1 - (e**2).sum() / ((part["target"] - part["target"].mean()) ** 2).sum()])
    assert got[0, "bad"]["n"] is None and got[0, "bad"]["error"] == "out of luck"
    monkeypatch.setattr(models, "fit_model", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("never")))
    with pytest.raises(RuntimeError):
        models.oof_predictions(df, folds, ["c"], ["x"], {"bad": good})


def test_mean_ensemble(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "pred_a double, pred_b double")
    assert models.add_mean_ensemble(df, ["pred_a", "pred_b"]).first()["pred_ensemble_mean"] == 2.0
    assert models.add_mean_ensemble(df, ["pred_a"]).columns == ["pred_a", "pred_b"]


def test_plot_layouts(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3))
    df = spark.createDataFrame([(i, v.tolist(), 10.0 + i, 3e8) for i, v in enumerate(x)], "id int, a array<double>, area_m2_clean double, rent_deposit_median double")
    df = df.withColumn("features", array_to_vector("a"))
    read = lambda layout: {r["id"]: (r["cluster_x"], r["cluster_y"]) for r in risk.plot_coords(df, layout).collect()}
    assert read(None)[3] == read({"axes": True, "pca": None})[3] == (13.0, 3.0)
    assert read({})[3] == (13.0, pytest.approx(np.log1p(3e8)))
    points = read({"points": (x[:1], np.array([[5.0, 6.0]]))})
    assert points[7] == pytest.approx((5.0, 6.0))
    pc, fitted = anomaly.pca_2d(df, "features")
    want = {r["id"]: (r["pca_x"], r["pca_y"]) for r in pc.collect()}
    assert read({"pca": fitted}) == want
