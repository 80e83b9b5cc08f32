import numpy as np
import pandas as pd
import pytest

from fairlease.operators import quality


def _pandas_cascade(pdf, col, groups, method):
    def mode_or_nan(s):
        s = s.dropna()
        return np.nan if s.empty else s.mode().iloc[0]

    filled = pdf[col].copy()
    for g in groups:
        keys = [pdf[c] for c in g]
        if method == "mode":
            m = filled.groupby(keys, dropna=False).transform(mode_or_nan)
        else:
            m = filled.groupby(keys, dropna=False).transform("median")
        filled = filled.fillna(m)
    return filled.fillna(mode_or_nan(filled) if method == "mode" else filled.median())


@pytest.mark.parametrize("method", ["mode", "median"])
def test_impute_cascade_matches_pandas(spark, method):
    rows = [
        (1, "apt", "x", 2.0), (2, "apt", "x", None), (3, "apt", "x", 3.0), (4, "apt", "y", None), (5, "apt", "y", None),
        (6, "rh", None, 1.0), (7, "rh", None, None), (8, "rh", "z", None), (9, None, "z", None), (10, None, None, 5.0),
        (11, "apt", "x", 3.0), (12, "apt", "x", 2.0),
    ]
    df = spark.createDataFrame(rows, "id int, pt string, ht string, v double")
    groups = [("pt", "ht"), ("pt",)]
    got = {r["id"]: r["v_imputed"] for r in quality.impute_cascade(df, "v", groups, method, "v_imputed").collect()}
    pdf = df.toPandas()
    exp = _pandas_cascade(pdf, "v", groups, method)
    for i, e in zip(pdf["id"], exp):
        assert got[i] == pytest.approx(e)


def test_flag_duplicates_null_safe(spark):
    df = spark.createDataFrame([("a", None, "1"), ("a", None, "2"), ("b", 1.0, "3"), ("b", 1.0, "0")], "k string, v double, rk string")
    got = {r["rk"]: r["is_exact_duplicate"] for r in quality.flag_duplicates(df, ["k", "v"], "rk").collect()}
    assert got == {"1": False, "2": True, "3": True, "0": False}


def test_winsorize_keeps_null(spark):
    rows = [(float(i),) for i in range(100)] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    out = quality.winsorize(df, ["x"], 0.01, 0.99).collect()
    vals = [r["x_winsor"] for r in out]
    assert None in vals
    s = pd.Series([r[0] for r in rows], dtype=float)
    assert min(v for v in vals if v is not None) == pytest.approx(s.quantile(0.01))
    assert max(v for v in vals if v is not None) == pytest.approx(s.quantile(0.99))


def test_robust_stats_match_pandas(spark):
    from fairlease.operators.stats import robust_stats

    rng = np.random.default_rng(9)
    rows = [(g, float(v)) for g in ("a", "b") for v in rng.normal(size=50)] + [("c", 1.0), ("c", 1.0), ("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in robust_stats(df, "x", by=["g"]).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for g, grp in pdf.groupby("g"):
        x = grp["x"]
        med = x.median()
        iqr = x.quantile(0.75) - x.quantile(0.25)
        exp_iqr = iqr if iqr > 0 else x.std(ddof=0)
        assert got[g]["median"] == pytest.approx(med)
        assert got[g]["iqr"] == pytest.approx(exp_iqr)
        assert got[g]["mad"] == pytest.approx((x - med).abs().median())
