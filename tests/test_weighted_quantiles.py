"""Weighted percentiles by value ranges equal the aggregate's, however a group is split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlease.operators import lookup, quality, quantiles

SPECS = [("q0", 0.0), ("q1", 0.01), ("q50", 0.5), ("q85", 0.85), ("q100", 1.0)]


@pytest.mark.parametrize("hot_rows", [0, 30, 10**9])
def test_equal_to_repeated_values(spark, hot_rows):
    rng = np.random.default_rng(hot_rows % 97)
    rows = [(str(rng.integers(0, 4)) if rng.random() < 0.9 else None, float(rng.integers(0, 60)) if rng.random() < 0.9 else None, int(rng.integers(1, 9))) for _ in range(400)]
    rows += [("one", 7.0, 1000), ("none", None, 3)]
    df = spark.createDataFrame(rows, "k string, v double, w long")
    got = {r["k"]: tuple(r[o] for o, _ in SPECS) for r in quantiles.weighted_percentiles(df, ["k"], "v", "w", SPECS, hot_rows).collect()}
    held = {}
    for k, v, w in rows:
        if v is not None:
            held.setdefault(k, []).extend([v] * w)
    assert got.keys() == held.keys()
    for k, v in held.items():
        assert np.allclose(got[k], np.quantile(v, [p for _, p in SPECS]), rtol=0, atol=1e-9)
    whole = quantiles.weighted_percentiles(df, [], "v", "w", SPECS, hot_rows).collect()
    assert len(whole) == 1 and np.allclose([whole[0][o] for o, _ in SPECS], np.quantile(sum(held.values(), []), [p for _, p in SPECS]))


@pytest.mark.parametrize("hot_rows", [0, 10**9])
def test_no_values(spark, hot_rows):
    df = spark.createDataFrame([("a", None, 1)], "k string, v double, w long")
    assert quantiles.weighted_percentiles(df, ["k"], "v", "w", SPECS, hot_rows).count() == 0
    assert quantiles.weighted_percentiles(df, [], "v", "w", SPECS, hot_rows).count() == 0


def test_one_group_of_a_million_values_is_split(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        df = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("v"), (F.col("id") % 3 + 1).alias("w"))
        asked = [("m", 0.5), ("h", 0.999)]
        assert "percentile(" not in quantiles._split_percentiles(df, ["k"], "v", "w", asked)._jdf.queryExecution().optimizedPlan().toString()
        got = quantiles.weighted_percentiles(df, ["k"], "v", "w", asked, hot_rows=1000)
        ids = np.arange(1_000_000)
        v, w = (ids * 7919 % 1_000_003).astype(float), ids % 3 + 1
        held = np.sort(np.repeat(v, w))
        r = got.collect()[0]
        assert [r["m"], r["h"]] == pytest.approx(list(np.quantile(held, [0.5, 0.999])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hot_rows", [0, 10**9])
def test_cascade_does_not_depend_on_the_split(spark, hot_rows):
    rng = np.random.default_rng(4)
    rows = [(i, str(rng.integers(0, 3)), str(rng.integers(0, 20)), float(rng.integers(0, 50)) if rng.random() < 0.4 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a string, b string, v double")
    got = {r["id"]: r["v_imputed"] for r in quality.impute_cascade(df, "v", [("a", "b"), ("a",)], "median", hot_rows=hot_rows).collect()}
    pdf = df.toPandas()
    filled = pdf["v"]
    for keys in (["a", "b"], ["a"]):
        filled = filled.fillna(filled.groupby([pdf[k] for k in keys]).transform("median"))
    filled = filled.fillna(filled.median())
    assert np.allclose([got[i] for i in pdf["id"]], filled)


def test_lookup_levels_do_not_depend_on_the_split(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(str(rng.integers(0, 3)), str(rng.integers(0, 2)), f"2020-0{rng.integers(1, 4)}", float(rng.integers(0, 40))) for _ in range(500)]
    df = spark.createDataFrame(rows, "gu_name string, property_type string, ym string, rent_deposit_median double")
    read = lambda: sorted(map(str, lookup.build_median_lookup(df).collect()))
    want = read()
    monkeypatch.setattr(lookup, "HOT_GROUP_ROWS", 0)
    monkeypatch.setattr(quantiles.weighted_percentiles, "__defaults__", (0, None))
    assert read() == want
