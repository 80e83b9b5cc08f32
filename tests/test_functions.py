import datetime as dt
import math

from pyspark.sql import functions as F

from fairlease.functions import columns as C


def test_to_number_lenient(spark):
    df = spark.createDataFrame([(" 12 ",), ("",), ("a",), (None,), ("1,234.5",), ("NaN",)], "s string")
    got = [r[0] for r in df.select(C.to_number("s")).collect()]
    assert got == [12.0, None, None, None, 1234.5, None]


def test_assemble_date_invalid_is_null(spark):
    df = spark.createDataFrame([(2024.0, 2.0, 30.0), (2024.0, 2.0, 29.0), (None, 1.0, 1.0), (2024.0, 1.5, 1.0)], "y double, m double, d double")
    got = [r[0] for r in df.select(C.assemble_date("y", "m", "d")).collect()]
    assert got == [None, dt.date(2024, 2, 29), None, None]


def test_housing_type_and_null(spark):
    df = spark.createDataFrame([("아파트",), (" 다세대주택 ",), ("기타",), (None,)], "t string")
    got = [r[0] for r in df.select(C.normalize_housing_type("t")).collect()]
    assert got == ["apt", "rh", "other", None]


def test_safe_ratio_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(C.safe_ratio("a", "b")).collect()] == [None, None, 1.5]


def test_lease_kind_null_rent_is_jeonse(spark):
    df = spark.createDataFrame([(None,), (0.0,), (10.0,)], "r double")
    assert [r[0] for r in df.select(C.lease_kind("r")).collect()] == ["jeonse", "jeonse", "monthly"]


def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (-1.0,), (200.0,), (50.0,)], "x double")
    assert [r[0] for r in df.select(C.clip("x", 0, 100)).collect()] == [None, None, 0.0, 100.0, 50.0]


def test_band_tables(spark):
    df = spark.createDataFrame([(85.0,), (60.0,), (40.0,), (10.0,), (None,)], "x double")
    assert [r[0] for r in df.select(C.band("x", C.RISK_BANDS_SCORING)).collect()] == ["high_risk", "caution", "fair", "safe", "safe"]
    assert [r[0] for r in df.select(C.band("x", C.GRADE_BANDS)).collect()] == ["매우 높음", "높음", "보통", "매우 낮음", "매우 낮음"]


def test_combo_and_missing(spark):
    df = spark.createDataFrame([("A", None, "2024-01")], "gu_name string, property_type string, ym string")
    r = C.add_combo_features(df).first()
    assert r["gu_property"] == "A____MISSING__"
    assert "housing_type_ym" not in r.asDict()


def test_extract_region(spark):
    df = spark.createDataFrame([("서울특별시 강남구 역삼동",), ("경기도 성남시",)], "a string")
    assert [r[0] for r in df.select(C.extract_region("a")).collect()] == ["강남구", None]


def test_row_std_ddof1(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (1.0, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(C.row_std(["a", "b", "c"])).collect()]
    assert math.isclose(got[0], 1.5275252316519468) and got[1] is None
