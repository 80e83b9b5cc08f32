"""Fixture binding: the driver's star-schema tables stand in for listings, leases and sales.

``lineitem ⋈ supplier ⋈ nation ⋈ part``, every row; return flag N/A/R selects
listings / leases / sales.  Written with the DataFrame API so the flag is pushed
down and only the used columns are read.
The nation dimension (25 rows, fixed) is broadcast; supplier and part joins are
left to AQE, whose broadcast decision is size-checked at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlease.functions import columns as C

# Fixed values of the fixture binding.
START_YM, END_YM = "1995-01", "2001-12"  # ship months of the tables
FIXTURE_TYPE_MAP = {
    "STANDARD": "apt",
    "SMALL": "rh",
    "MEDIUM": "officetel",
    "LARGE": "detached",
    "ECONOMY": "urban",
}
FLAG_ROLE = {"N": "listing", "A": "lease", "R": "sale"}

_LI_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _bound(spark: SparkSession, sf_dir: str, flags: tuple[str, ...]) -> DataFrame:
    li = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .select(*_LI_COLS)
        .filter(F.col("l_returnflag").isin(*flags))
    )
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    nat = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_brand", "p_size")
    j = (
        li.join(sup, li.l_suppkey == sup.s_suppkey)
        .join(F.broadcast(nat), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    ym = C.month_key("l_shipdate")
    price_units = F.round(F.col("l_extendedprice") * 100)
    deposit = price_units * 10
    return j.select(
        F.col("l_returnflag").alias("rf"),
        F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("gu_code"),
        F.col("n_name").alias("gu_name"),
        ym.alias("ym"),
        F.col("l_shipdate").cast("date").alias("contract_date"),
        C.normalize_housing_type("p_type", FIXTURE_TYPE_MAP).alias("property_type"),
        F.col("p_type").alias("housing_type"),
        F.col("p_brand").alias("detail_type"),
        F.nullif(F.col("p_size") % 9, F.lit(0)).cast("double").alias("room_count"),
        F.when(F.col("l_linestatus") == "F", F.lit(None).cast("double"))
        .otherwise(F.col("l_linenumber").cast("double"))
        .alias("household_size"),
        ((F.col("l_quantity") - 1) * (F.col("l_quantity") - 1) / 7.5).alias("area_m2"),
        deposit.alias("deposit_won"),
        (deposit * (1 - F.col("l_discount") * 8)).alias("support_won"),
        F.when(F.col("l_tax") < 0.04, F.lit(0.0)).otherwise(F.round(F.col("l_extendedprice") * F.col("l_tax") * 10)).alias(
            "monthly_rent_won"
        ),
        F.concat_ws(
            "|",
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            price_units.cast("bigint"), F.col("l_quantity").cast("bigint"),
            ym, "l_returnflag", "l_linestatus",
        ).alias("row_key"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing table (clean): one row per subject listing."""
    b = _bound(spark, sf_dir, ("N",))
    return b.select(
        "gu_code", "gu_name", "ym", "contract_date", "property_type", "housing_type", "detail_type",
        "room_count", "area_m2", "household_size", "deposit_won", "support_won",
        (F.col("deposit_won") - F.col("support_won")).alias("tenant_deposit_won"),
        "monthly_rent_won",
        C.safe_ratio("deposit_won", "area_m2").alias("deposit_per_m2"),
        C.safe_ratio("support_won", "deposit_won").alias("support_ratio"),
        "row_key",
    )


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lease transactions (clean)."""
    b = _bound(spark, sf_dir, ("A",))
    return b.select(
        F.lit("rent").alias("trade_type"), "property_type", "gu_code", "gu_name", "ym", "contract_date",
        "deposit_won", "monthly_rent_won", "area_m2",
        C.lease_kind("monthly_rent_won").alias("rent_type"),
        C.safe_ratio("deposit_won", "area_m2").alias("deposit_per_m2"),
        C.safe_ratio("monthly_rent_won", "area_m2").alias("monthly_rent_per_m2"),
        "row_key",
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale transactions (clean); the price is the bound deposit amount."""
    b = _bound(spark, sf_dir, ("R",))
    return b.select(
        F.lit("sale").alias("trade_type"), "property_type", "gu_code", "gu_name", "ym", "contract_date",
        F.col("deposit_won").alias("sale_price_won"), "area_m2",
        C.safe_ratio("deposit_won", "area_m2").alias("sale_price_per_m2"),
        "row_key",
    )


def all_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, ("N", "A", "R"))
