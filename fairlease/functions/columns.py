"""Scalar column functions (JVM-side expressions only, no Python UDFs).

Each helper returns a ``Column`` so it stays inside whole-stage codegen.
NaN is folded to NULL wherever a value enters from outside, because Spark
orders NaN above every number (it would win ``greatest`` and percentiles).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "__MISSING__"

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (labels, thresholds, maps).
# ---------------------------------------------------------------------------
# Housing-type normalisation: source label -> property type.
HOUSING_TYPE_MAP: dict[str, str] = {
    "아파트": "apt",
    "연립주택": "rh",
    "다세대주택": "rh",
    "오피스텔": "officetel",
    "다가구용단독주택": "detached",
    "단독주택": "detached",
    "다중주택": "detached",
    "도시형생활주택": "urban",
}
HOUSING_TYPE_DEFAULT = "other"
IN_DOMAIN_TYPES = ("apt", "rh", "officetel", "detached")
OOD_TYPES = ("urban", "other")
# Region extraction pattern from a street address.
REGION_PATTERN = r"서울특별시\s+([가-힣]+구)"
# Score bands, highest first: (lower bound inclusive, label).
GRADE_BANDS = ((80, "매우 높음"), (60, "높음"), (40, "보통"), (20, "낮음"), (None, "매우 낮음"))
RISK_BANDS_TRAINING = ((80, "high_risk"), (60, "caution"), (40, "monitor"), (None, "low"))
RISK_BANDS_SCORING = ((80, "high_risk"), (60, "caution"), (40, "fair"), (None, "safe"))
# Model scope for a property type: (score, label, status, message).
SCOPE_IN_DOMAIN = (0, "양호", "in_domain", "학습 데이터에 포함된 주택유형입니다.")
SCOPE_OOD_SCORE, SCOPE_OOD_LABEL, SCOPE_OOD_STATUS = 75, "주의", "out_of_domain"
SCOPE_OOD_NAMES = {"urban": "도시형생활주택", "other": "복합/기타 주택"}
SCOPE_UNKNOWN_NAME = "알 수 없음"
SCOPE_OOD_SUFFIX = "은 직접 학습 범위 밖 유형입니다. 예측값은 유사 패턴 기준 참고값으로 해석하세요."
# Combination categoricals: new column -> source columns.
COMBO_SPECS: dict[str, tuple[str, ...]] = {
    "gu_property": ("gu_name", "property_type"),
    "gu_ym": ("gu_name", "ym"),
    "property_ym": ("property_type", "ym"),
    "housing_type_ym": ("housing_type", "ym"),
    "detail_type_ym": ("detail_type", "ym"),
}


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(col: str | Column) -> Column:
    c = _c(col)
    return F.when(~F.isnan(c), c)


# B1 ---------------------------------------------------------------------------
def to_number(col: str | Column) -> Column:
    """Lenient number parse: drop thousands separators, trim, blank/invalid -> NULL."""
    text = F.trim(F.replace(_c(col).cast("string"), F.lit(","), F.lit("")))
    # the text stands here once: copies of it in a pushed filter can outgrow what the JVM compiles
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


# B2 ---------------------------------------------------------------------------
def pick(df: DataFrame, names: Iterable[str], default=None) -> Column:
    """First non-null among the listed columns that exist in ``df``."""
    present = [F.col(n) for n in names if n in df.columns]
    if not present:
        return F.lit(default)
    return present[0] if len(present) == 1 else F.coalesce(*present)


# B3 ---------------------------------------------------------------------------
def extract_region(col: str | Column, pattern: str = REGION_PATTERN) -> Column:
    """Region name captured from an address; NULL when the pattern does not match."""
    return F.nullif(F.regexp_extract(_c(col), pattern, 1), F.lit(""))


# B5 ---------------------------------------------------------------------------
def normalize_housing_type(
    col: str | Column, mapping: Mapping[str, str] = HOUSING_TYPE_MAP, default: str = HOUSING_TYPE_DEFAULT
) -> Column:
    """Map a housing label to apt/rh/officetel/detached/urban/other; NULL stays NULL."""
    v = F.trim(_c(col).cast("string"))
    expr = None
    for src, dst in mapping.items():
        expr = (F.when(v == src, dst)) if expr is None else expr.when(v == src, dst)
    expr = expr.otherwise(default)
    return F.when(_c(col).isNotNull(), expr)


# B6 ---------------------------------------------------------------------------
def assemble_date(year: str | Column, month: str | Column, day: str | Column) -> Column:
    """Date from numeric y/m/d parts; impossible dates become NULL (ANSI-safe)."""
    y, m, d = (_c(x).cast("double") for x in (year, month, day))
    ok = (y == F.floor(y)) & (m == F.floor(m)) & (d == F.floor(d))
    ts = F.try_make_timestamp(y.cast("int"), m.cast("int"), d.cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return F.when(ok, ts.cast("date"))


def parse_date(col: str | Column) -> Column:
    return F.try_to_date(_c(col).cast("string"))


# B7 ---------------------------------------------------------------------------
def month_key(col: str | Column) -> Column:
    return F.date_format(_c(col), "yyyy-MM")


def year_of_month(ym: str | Column) -> Column:
    return F.substring(_c(ym), 1, 4)


# B8 ---------------------------------------------------------------------------
def in_period(df: DataFrame, start: str, end: str, ym: str = "ym") -> DataFrame:
    """Inclusive month-range filter; NULL months drop. Prunes when ``ym`` is a partition column."""
    return df.filter(F.col(ym).between(start, end))


# B9 ---------------------------------------------------------------------------
def scale_amount(col: str | Column, unit: float = 10_000.0, digits: int = 6) -> Column:
    """Unit scaling (10,000-won units -> won).  Parsed decimals such as 8703.648 are not exact
    in binary, so the product is rounded to ``digits`` places to drop the representation noise."""
    return F.round(_c(col) * F.lit(unit), digits)


# B10 --------------------------------------------------------------------------
def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den with a zero or NULL denominator giving NULL."""
    return F.try_divide(_c(num), F.nullif(_c(den), F.lit(0.0)))


# B12 --------------------------------------------------------------------------
def lease_kind(monthly_rent: str | Column) -> Column:
    """'jeonse' when the monthly rent is zero or missing, else 'monthly'."""
    return F.when(F.coalesce(_c(monthly_rent), F.lit(0.0)) == 0, "jeonse").otherwise("monthly")


# B16 --------------------------------------------------------------------------
def add_combo_features(df: DataFrame, specs: Mapping[str, Iterable[str]] = COMBO_SPECS) -> DataFrame:
    """``a__b`` combination categoricals; NULL parts become ``__MISSING__``; skipped if a part is absent."""
    cols = {}
    for name, parts in specs.items():
        parts = list(parts)
        if all(p in df.columns for p in parts):
            cols[name] = F.concat_ws("__", *[norm_key(p) for p in parts])
    return df.withColumns(cols) if cols else df


# B17 --------------------------------------------------------------------------
def log1p_clipped(col: str | Column) -> Column:
    """log1p of a value clipped below at 0 (NULL stays NULL)."""
    c = _c(col)
    return F.log1p(F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))))


# B18 --------------------------------------------------------------------------
def norm_key(col: str | Column) -> Column:
    return F.coalesce(_c(col).cast("string"), F.lit(MISSING))


# B19 --------------------------------------------------------------------------
def band(col: str | Column, bands=RISK_BANDS_TRAINING) -> Column:
    """Chained thresholds, highest first; NULL score falls to the last band (as pandas' NaN would)."""
    c = _c(col)
    expr = None
    for lo, label in bands:
        if lo is None:
            return expr.otherwise(label) if expr is not None else F.lit(label)
        cond = c >= lo
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


# B20 --------------------------------------------------------------------------
def model_scope(df: DataFrame, property_type: str = "property_type") -> DataFrame:
    """Scope score/label/status/message for a property type (in-domain vs out-of-domain)."""
    pt = F.col(property_type)
    inside = pt.isin(*IN_DOMAIN_TYPES)
    name = F.coalesce(
        *[F.when(pt == k, F.lit(v)) for k, v in SCOPE_OOD_NAMES.items()],
        F.when(pt.isNull() | (pt == ""), F.lit(SCOPE_UNKNOWN_NAME)),
        pt,
    )
    return df.withColumns(
        {
            "model_scope_score": F.when(inside, F.lit(SCOPE_IN_DOMAIN[0])).otherwise(F.lit(SCOPE_OOD_SCORE)),
            "model_scope_label": F.when(inside, F.lit(SCOPE_IN_DOMAIN[1])).otherwise(F.lit(SCOPE_OOD_LABEL)),
            "model_scope_status": F.when(inside, F.lit(SCOPE_IN_DOMAIN[2])).otherwise(F.lit(SCOPE_OOD_STATUS)),
            "model_scope_message": F.when(inside, F.lit(SCOPE_IN_DOMAIN[3])).otherwise(
                F.concat(name, F.lit(SCOPE_OOD_SUFFIX))
            ),
        }
    )


# B23 --------------------------------------------------------------------------
def clip(col: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi]; NULL/NaN stays NULL (pandas ``clip`` keeps NaN)."""
    c = nan_to_null(col)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def row_mean(cols: Iterable[str | Column]) -> Column:
    """Row mean skipping NULLs (pandas ``mean(axis=1)``)."""
    cols = [_c(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in cols), F.lit(0))
    return F.try_divide(total, n.cast("double"))


def row_std(cols: Iterable[str | Column]) -> Column:
    """Row sample standard deviation (ddof=1) over non-null values; NULL below two values."""
    arr = F.filter(F.array(*[_c(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    n = F.size(arr).cast("double")
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n
    ss = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n >= 2, F.sqrt(ss / (n - 1)))


# B21 ----------------------------------------------------------------------------
# Fixed values of a listing request: district codes and property-type labels.
GU_CODES = {
    "강남구": "11680", "강동구": "11740", "강북구": "11305", "강서구": "11500", "관악구": "11620", "광진구": "11215", "구로구": "11530",
    "금천구": "11545", "노원구": "11350", "도봉구": "11320", "동대문구": "11230", "동작구": "11590", "마포구": "11440", "서대문구": "11410",
    "서초구": "11650", "성동구": "11200", "성북구": "11290", "송파구": "11710", "양천구": "11470", "영등포구": "11560", "용산구": "11170",
    "은평구": "11380", "종로구": "11110", "중구": "11140", "중랑구": "11260",
}
PROPERTY_LABELS = {"아파트": "apt", "오피스텔": "officetel", "연립/다세대": "rh", "단독/다가구": "detached", "도시형생활주택": "urban", "복합/기타": "other"}
REQUEST_DEFAULTS = {"gu_name": "강남구", "property_label": "아파트", "ym": "2025-01", "area_m2_clean": 59.0, "room_count_clean": 3.0, "household_size_clean": 2.0}


def request_number(df: DataFrame, name: str, default: float | None = None) -> Column:
    """A number typed by a person: thousands separators and blanks dropped; absent or blank -> ``default``.
    What is no number gives NULL."""
    if name not in df.columns:
        return F.lit(default).cast("double")
    text = F.trim(F.regexp_replace(F.col(name).cast("string"), ",", ""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default).cast("double")).otherwise(F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double"))


def normalize_listing_input(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Listing requests as typed (all text) to the columns that valuation takes: district name -> code ('' if unknown),
    property label -> type (unknown labels stay), label as both housing types, numbers parsed, defaults filled in."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(REQUEST_DEFAULTS[name])) if name in df.columns else F.lit(REQUEST_DEFAULTS[name])
    table = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    gu, label = text("gu_name"), text("property_label")
    return df.select(
        *keep,
        gu.alias("gu_name"),
        F.coalesce(F.try_element_at(table(GU_CODES), gu), F.lit("")).alias("gu_code"),
        text("ym").alias("ym"),
        F.coalesce(F.try_element_at(table(PROPERTY_LABELS), label), label).alias("property_type"),
        label.alias("housing_type"),
        label.alias("detail_type"),
        request_number(df, "area_m2_clean", REQUEST_DEFAULTS["area_m2_clean"]).alias("area_m2_clean"),
        request_number(df, "room_count_clean", REQUEST_DEFAULTS["room_count_clean"]).alias("room_count_clean"),
        F.lit(REQUEST_DEFAULTS["household_size_clean"]).alias("household_size_clean"),
        request_number(df, "deposit_won").alias("deposit_won"),
    )
