import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlease.operators import ensemble, splits


def test_group_split_disjoint_and_complete(spark):
    rows = [(f"g{i % 37}", f"202{i % 4}-0{1 + i % 9}", "apt", float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "gu_code string, ym string, property_type string, v double")
    out, rep = splits.group_split(df)
    splits.assert_all_assigned(out)
    per_group = out.groupBy("gu_code", "ym", "property_type").agg(F.countDistinct("split").alias("n")).filter("n > 1").count()
    assert per_group == 0
    assert rep.agg(F.sum("groups")).first()[0] == df.select("gu_code", "ym", "property_type").distinct().count()


def test_sample_per_group_exact_counts(spark):
    rows = [("hot", f"r{i}") for i in range(3000)] + [("cold", f"c{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "k string, row_key string")
    got = {r["k"]: r["n"] for r in splits.sample_per_group(df, "k", 100).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == {"hot": 100, "cold": 5}


def test_simplex_weights_valid_and_better_than_equal(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=500)
    rows = [(float(t), float(t + rng.normal(0, 0.1)), float(t + rng.normal(0, 1.0)), float(rng.normal())) for t in y]
    df = spark.createDataFrame(rows, "target double, a double, b double, c double")
    w = ensemble.fit_simplex_weights(df, ["a", "b", "c"])
    assert all(v >= 0 for v in w.values()) and sum(w.values()) == pytest.approx(1.0)
    pdf = df.toPandas()
    rmse = lambda p: float(np.sqrt(np.mean((pdf["target"] - p) ** 2)))
    assert rmse(sum(pdf[k] * v for k, v in w.items())) <= rmse(pdf[["a", "b", "c"]].mean(axis=1)) + 1e-12


def test_ridge_loo_matches_bruteforce(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    y = x @ np.array([0.7, 0.2]) + 0.3 + rng.normal(0, 0.2, 80)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, target double")
    m = ensemble.RidgeStack(alphas=[0.01, 1.0, 100.0]).fit(df, ["a", "b"])

    def loo(alpha):
        err = 0.0
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            xm, ym = x[keep].mean(axis=0), y[keep].mean()
            xc, yc = x[keep] - xm, y[keep] - ym
            beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
            err += (y[i] - (ym + (x[i] - xm) @ beta)) ** 2
        return err

    best = min([0.01, 1.0, 100.0], key=loo)
    assert m.alpha_ == best


def test_upsert_new_beats_old_and_keeps_test_only(spark):
    old = spark.createDataFrame(
        [("e", "m1", "test", 0.5), ("e", "m2", "test", 0.4), ("e", "m1", "valid", 0.3)], "experiment string, model string, split string, rmse double"
    )
    new = spark.createDataFrame(
        [("e", "default", "m1", "test", 0.2, "t"), ("e", "default", "m3", "valid", 0.1, "t")],
        "experiment string, run_name string, model string, split string, rmse double, target string",
    )
    out = {(r["run_name"], r["model"], r["split"]): r["rmse"] for r in splits.upsert_scores(old, new).collect()}
    assert out == {("legacy", "m1", "test"): 0.5, ("legacy", "m2", "test"): 0.4, ("legacy", "m1", "valid"): 0.3, ("default", "m1", "test"): 0.2}


def test_group_split_three_groups_one_each(spark):
    rows = [(g, "2024-01", "apt", 1.0) for g in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "gu_code string, ym string, property_type string, v double")
    out, _ = splits.group_split(df)
    assert sorted(r["split"] for r in out.collect()) == ["test", "train", "valid"]
