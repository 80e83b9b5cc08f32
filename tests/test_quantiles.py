import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from fairlease.operators import quantiles
from fairlease.operators.quantiles import global_percentiles, group_percentiles


def _frame(spark):
    rows = []
    rng = np.random.default_rng(0)
    for k in ["a", "b", None]:
        for _ in range(40):
            rows.append((k, float(rng.integers(0, 10))))  # heavy ties
    rows += [("allnull", None), ("allnull", None), ("single", 3.5)]
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("strategy", ["hash", "sorted"])
def test_group_percentiles_match_pandas(spark, strategy):
    df = _frame(spark)
    got = {r["k"]: (r["q50"], r["q10"]) for r in group_percentiles(df, ["k"], [("q50", "v", 0.5), ("q10", "v", 0.1)], strategy).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("k", dropna=False):
        key = None if (isinstance(k, float) and np.isnan(k)) else k
        vals = g["v"].dropna()
        exp = (vals.quantile(0.5), vals.quantile(0.1)) if len(vals) else (None, None)
        a, b = got[key]
        if exp[0] is None:
            assert a is None and b is None
        else:
            assert a == pytest.approx(exp[0]) and b == pytest.approx(exp[1])


def test_auto_splits_hot_groups(spark):
    df = _frame(spark)
    hot = {r["k"]: r["q"] for r in group_percentiles(df, ["k"], [("q", "v", 0.5)], "auto", hot_rows=10).collect()}
    cold = {r["k"]: r["q"] for r in group_percentiles(df, ["k"], [("q", "v", 0.5)], "hash").collect()}
    assert hot == cold


def test_global_sorted(spark):
    df = _frame(spark)
    a = global_percentiles(df, [("q", "v", 0.99)], "sorted").first()["q"]
    b = global_percentiles(df, [("q", "v", 0.99)], "hash").first()["q"]
    assert a == pytest.approx(b)


def test_market_auto_with_hot_cells_equals_hash(spark):
    """Cells above hot_rows take the range-partitioned path; the rest the hash path; same result."""
    from fairlease.operators import market
    from fairlease.sources import binding

    les = binding.leases(spark, "/root/testdata/sf0.001")
    cols = ["gu_code", "gu_name", "ym", "property_type", "rent_deposit_median", "rent_deposit_per_m2_median", "monthly_rent_median", "area_m2_median"]
    mixed = market.lease_market_features(les, strategy="auto", hot_rows=1).select(*cols)
    plain = market.lease_market_features(les, strategy="hash").select(*cols)
    assert mixed.count() == plain.count()
    assert mixed.exceptAll(plain).count() == 0 and plain.exceptAll(mixed).count() == 0


def _values(spark):
    v = F.col("id")
    return spark.range(5000).select(
        F.when(v % 11 != 0, F.sqrt(v * 37 % 4999)).alias("a"), F.when(v % 3 == 0, 1.0).when(v % 3 == 1, float("nan")).otherwise(v % 7 - 0.5).alias("ties"),
        F.when(v > 4000, float("inf")).when(v < 50, float("-inf")).otherwise(v.cast("double")).alias("ends"), F.lit(None).cast("double").alias("none"),
    )


_ASKED = [(f"{c}{i}", c, p) for c in ("a", "ties", "ends", "none") for i, p in enumerate((0.0, 0.01, 0.3333, 0.5, 0.99, 1.0))]


def test_narrowed_percentiles_are_exact(spark, monkeypatch):
    df = _values(spark).repartition(7)
    want = global_percentiles(df, _ASKED, "hash").first()
    monkeypatch.setattr(quantiles, "_sorted_percentiles", None)  # no row is sorted for them
    assert global_percentiles(df, _ASKED, hot_rows=100).first() == want
    monkeypatch.setattr(quantiles, "NARROWED", 100)  # a rougher sketch keeps wider ranges
    assert global_percentiles(df, _ASKED, hot_rows=100).first() == want


def test_a_percentile_outside_its_range_is_sorted_for(spark, monkeypatch):
    df = _values(spark).select("a", "ties")
    asked = [s for s in _ASKED if s[1] in df.columns]
    want = global_percentiles(df, asked, "hash").first()
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, *_: F.array(*[F.min(c)] * 20))
    assert global_percentiles(df, asked, "narrowed").first() == want
