"""Cleaning composites: raw string extracts -> typed listings / leases / sales.

Pure projections plus one broadcast join to the region dimension (a few dozen
rows, fixed by geography) and a month-range filter; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlease.functions import columns as C

# Raw column names of the source extracts (API tags and listing file headers).
LEASE_AREA_TAGS = ("excluUseAr", "totalFloorAr", "전용면적", "연면적")
SALE_AREA_TAGS = ("excluUseAr", "totalFloorAr", "buildingAr", "전용면적", "연면적")
SALE_LAND_TAGS = ("plottageAr", "landAr", "대지면적")
BUILDING_TAGS = ("aptNm", "mhouseNm", "offiNm", "단지")
LISTING_COLUMNS = {
    "address": "주소",
    "contract_date": "계약일자",
    "housing_type": "주택유형",
    "detail_type": "유형",
    "room_count": "방갯수",
    "area": "전용면적",
    "household_size": "세대원수",
    "deposit": "전세금",
    "support": "전세지원금",
    "monthly_rent": "월임대료",
}
START_YM, END_YM = "2022-01", "2025-12"
PROVINCE = "서울특별시"


# B4 ---------------------------------------------------------------------------
def region_dim(codes: DataFrame, province: str = PROVINCE) -> DataFrame:
    """Active districts of one province: 5-char code prefix + district name, distinct, by code.

    ``codes`` has columns 법정동코드 / 시도명 / 시군구명 / 삭제일자 (legal-area code table).
    """
    active = codes.filter((F.col("시도명") == province) & F.col("삭제일자").isNull() & F.col("시군구명").isNotNull())
    return (
        active.select(F.substring(F.col("법정동코드").cast("string"), 1, 5).alias("gu_code"), F.col("시군구명").alias("gu_name"))
        .distinct()
        .orderBy("gu_code")
    )


def _trades_common(raw: DataFrame, trade_type: str) -> dict:
    y, m, d = (C.to_number(C.pick(raw, [t])) for t in ("dealYear", "dealMonth", "dealDay"))
    date = C.assemble_date(y, m, d)
    return {
        "trade_type": F.lit(trade_type),
        "property_type": C.pick(raw, ["property_type"]),
        "gu_code": F.substring(C.pick(raw, ["sggCd", "request_gu_code"]).cast("string"), 1, 5),
        "dong_name": C.pick(raw, ["umdNm"]),
        "house_type": C.pick(raw, ["houseType"]),
        "jibun": C.pick(raw, ["jibun"]),
        "contract_year": y,
        "contract_month": m,
        "contract_day": d,
        "contract_date": date,
        "ym": C.month_key(date),
        "floor": C.to_number(C.pick(raw, ["floor"])),
        "build_year": C.to_number(C.pick(raw, ["buildYear"])),
    }


# B14 --------------------------------------------------------------------------
def clean_leases(raw: DataFrame, regions: DataFrame, start: str = START_YM, end: str = END_YM) -> DataFrame:
    cols = _trades_common(raw, "rent")
    cols["building_name"] = C.pick(raw, BUILDING_TAGS)
    cols["deposit_won"] = C.scale_amount(C.to_number(C.pick(raw, ["deposit"])))
    cols["monthly_rent_won"] = C.scale_amount(C.to_number(C.pick(raw, ["monthlyRent"])))
    cols["area_m2"] = C.to_number(C.pick(raw, LEASE_AREA_TAGS))
    cols["contract_term"] = C.pick(raw, ["contractTerm"])
    cols["contract_type"] = C.pick(raw, ["contractType"])
    extra = [c for c in ("row_key",) if c in raw.columns]
    out = raw.select(*[v.alias(k) for k, v in cols.items()], *extra)
    out = out.withColumns(
        {
            "rent_type": C.lease_kind("monthly_rent_won"),
            "deposit_per_m2": C.safe_ratio("deposit_won", "area_m2"),
            "monthly_rent_per_m2": C.safe_ratio("monthly_rent_won", "area_m2"),
        }
    )
    out = out.join(F.broadcast(regions.select("gu_code", "gu_name")), "gu_code", "left")
    return C.in_period(out, start, end)


# B15 --------------------------------------------------------------------------
def clean_sales(raw: DataFrame, regions: DataFrame, start: str = START_YM, end: str = END_YM) -> DataFrame:
    cols = _trades_common(raw, "sale")
    cols["building_name"] = C.pick(raw, BUILDING_TAGS[:3])
    cols["sale_price_won"] = C.scale_amount(C.to_number(C.pick(raw, ["dealAmount"])))
    cols["area_m2"] = C.to_number(C.pick(raw, SALE_AREA_TAGS))
    cols["land_area_m2"] = C.to_number(C.pick(raw, SALE_LAND_TAGS))
    extra = [c for c in ("row_key",) if c in raw.columns]
    out = raw.select(*[v.alias(k) for k, v in cols.items()], *extra)
    out = out.withColumn("sale_price_per_m2", C.safe_ratio("sale_price_won", "area_m2"))
    out = out.join(F.broadcast(regions.select("gu_code", "gu_name")), "gu_code", "left")
    return C.in_period(out, start, end)


# B13 --------------------------------------------------------------------------
def clean_listings(raw: DataFrame, regions: DataFrame, names: dict = LISTING_COLUMNS, pattern: str = C.REGION_PATTERN) -> DataFrame:
    """Region from the address (rows without one dropped), region code by name, typed values,
    tenant share and per-m² / support ratios."""
    n = names
    out = raw.withColumn("gu_name", C.extract_region(n["address"], pattern)).filter(F.col("gu_name").isNotNull())
    out = out.join(F.broadcast(regions.select("gu_code", "gu_name")), "gu_name", "left")
    date = C.parse_date(F.col(n["contract_date"]))
    deposit = C.to_number(n["deposit"])
    support = C.to_number(n["support"])
    area = C.to_number(n["area"])
    extra = [c for c in ("row_key",) if c in raw.columns]
    return out.select(
        "gu_code", "gu_name", C.month_key(date).alias("ym"), date.alias("contract_date"),
        C.normalize_housing_type(n["housing_type"]).alias("property_type"),
        F.col(n["housing_type"]).alias("housing_type"), F.col(n["detail_type"]).alias("detail_type"),
        C.to_number(n["room_count"]).alias("room_count"), area.alias("area_m2"),
        C.to_number(n["household_size"]).alias("household_size"),
        deposit.alias("deposit_won"), support.alias("support_won"), (deposit - support).alias("tenant_deposit_won"),
        C.to_number(n["monthly_rent"]).alias("monthly_rent_won"),
        C.safe_ratio(deposit, area).alias("deposit_per_m2"), C.safe_ratio(support, deposit).alias("support_ratio"),
        F.col(n["address"]).alias("address"), *extra,
    )
