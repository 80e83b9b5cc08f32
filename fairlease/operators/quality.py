"""Quality flags, masking, cascading imputation, winsorisation, domain split.

Stats-then-apply: every statistic is computed once as a small DataFrame
(group stats or a one-row bounds table) and joined back, never collected.
Group statistics use aggregate + join rather than ``Window.partitionBy`` so
a hot group is combined map-side instead of being buffered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlease.functions.columns import IN_DOMAIN_TYPES, OOD_TYPES, nan_to_null, safe_ratio
from fairlease.operators.quantiles import HOT_GROUP_ROWS, _null_safe_join, global_percentiles, weighted_percentiles
from fairlease.session import materialize

# Fixed rule thresholds (must equal the reference's).
AREA_MIN_M2 = 5
AREA_DROP_MAX_M2 = 300
AREA_REVIEW_MIN_M2 = 150
ROOM_MAX = 6
SALE_LOW_CONFIDENCE_TXN_COUNT = 10
SUPPORT_RATIO_LOW = 0.3
WINSOR_LOW, WINSOR_HIGH = 0.01, 0.99
WINSOR_COLUMNS = (
    "lh_vs_rent_median_ratio",
    "lh_vs_sale_median_ratio",
    "jeonse_to_sale_ratio_median",
    "deposit_per_m2_clean",
)
FLAG_COLUMNS = (
    "is_ood_property_type",
    "is_exact_duplicate",
    "area_missing_or_zero",
    "area_too_small",
    "area_review_large",
    "area_too_large",
    "room_missing",
    "room_too_large",
    "household_size_missing_or_zero",
    "sale_feature_missing",
    "sale_low_confidence",
    "rent_feature_missing",
    "support_ratio_low",
    "lh_vs_sale_ratio_gt_1",
    "jeonse_to_sale_ratio_gt_1",
)
ROOM_GROUPS = (("property_type", "housing_type"), ("property_type",))
HOUSEHOLD_GROUPS = (("property_type", "detail_type"), ("property_type",))


def _b(cond: Column) -> Column:
    """Comparison with NULL is False (pandas NaN semantics), never NULL."""
    return F.coalesce(cond, F.lit(False))


# C2 ---------------------------------------------------------------------------
def flag_duplicates(df: DataFrame, cols: Sequence[str], order: str, name: str = "is_exact_duplicate") -> DataFrame:
    """True for every row but the first (by ``order``) among rows equal on ``cols`` (NULL equals NULL).

    The first row per group comes from a partial aggregate, so a group of copies
    holding a third of the table is reduced map-side; the join back is skew-split by AQE.
    Only groups of several rows are joined back, on a hash of the columns: rows are dealt and sorted by one
    number, and the columns themselves still decide among equal hashes.  A NULL order key comes last; never NULL.
    """
    keyed = df.withColumn("__alike", F.xxhash64(*cols) if cols else F.lit(0).cast("long"))
    firsts = keyed.groupBy("__alike", *cols).agg(F.min(F.struct(F.col(order).isNull(), F.col(order))).alias("__first"), F.count(F.lit(1)).alias("__n"))
    firsts = firsts.where("__n > 1").select(F.col("__alike").alias("__r_alike"), *[F.col(c).alias(f"__r_{i}") for i, c in enumerate(cols)], "__first")
    # the hash in both structs keeps the columns out of the join's keys
    equal = F.struct("__r_alike", *cols).eqNullSafe(F.struct("__r_alike", *[f"__r_{i}" for i in range(len(cols))]))
    out = keyed.join(firsts, (F.col("__alike") == F.col("__r_alike")) & equal, "left")
    flag = F.col("__first").isNotNull() & ~F.col(order).eqNullSafe(F.col(f"__first.{order}"))
    return out.withColumn(name, flag).drop("__first", "__alike", "__r_alike", *[f"__r_{i}" for i in range(len(cols))])


# C1 ---------------------------------------------------------------------------
def add_quality_flags(df: DataFrame, dup_cols: Sequence[str] | None = None, order: str = "row_key") -> DataFrame:
    """The 16 boolean quality flags (never NULL); rows that bring the flag of duplicates keep it."""
    if "is_exact_duplicate" in df.columns:
        flagged = _domain_flags(df).withColumnRenamed("is_exact_duplicate", "__duplicate")
        return add_row_flags(flagged.withColumn("is_exact_duplicate", F.col("__duplicate")).drop("__duplicate"))
    dup_cols = list(dup_cols) if dup_cols is not None else [c for c in df.columns if c != order]
    return add_row_flags(flag_duplicates(_domain_flags(df), dup_cols, order))


def _domain_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_ood_property_type": _b(F.col("property_type").isin(*OOD_TYPES)),
            "is_in_domain_property_type": _b(F.col("property_type").isin(*IN_DOMAIN_TYPES)),
        }
    )


def add_row_flags(df: DataFrame) -> DataFrame:
    """The flags that a row decides alone: all but those of the domain and of duplicates."""
    area, rooms, hh = F.col("area_m2"), F.col("room_count"), F.col("household_size")
    sale_n, rent_n = F.col("sale_txn_count"), F.col("rent_txn_count")
    return df.withColumns(
        {
            "area_missing_or_zero": area.isNull() | _b(area <= 0),
            "area_too_small": _b((area > 0) & (area < AREA_MIN_M2)),
            "area_review_large": _b((area > AREA_REVIEW_MIN_M2) & (area <= AREA_DROP_MAX_M2)),
            "area_too_large": _b(area > AREA_DROP_MAX_M2),
            "room_missing": rooms.isNull(),
            "room_too_large": _b(rooms > ROOM_MAX),
            "household_size_missing_or_zero": hh.isNull() | _b(hh <= 0),
            "sale_feature_missing": sale_n.isNull(),
            "sale_low_confidence": sale_n.isNotNull() & _b(sale_n < SALE_LOW_CONFIDENCE_TXN_COUNT),
            "rent_feature_missing": rent_n.isNull(),
            "support_ratio_low": _b(F.col("support_ratio") < SUPPORT_RATIO_LOW),
            "lh_vs_sale_ratio_gt_1": _b(F.col("lh_vs_sale_median_ratio") > 1),
            "jeonse_to_sale_ratio_gt_1": _b(F.col("jeonse_to_sale_ratio_median") > 1),
        }
    )


# C3 ---------------------------------------------------------------------------
def mask(col: str | Column, invalid: Column) -> Column:
    """Value where ``invalid`` is False, else NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~invalid, c)


# C4 ---------------------------------------------------------------------------
def _weighted_stat(vc: DataFrame, keys: Sequence[str], method: str, rows: int, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Per-group statistic over a weighted (keys, __v, __w) table of ``rows`` rows, NULL values skipped."""
    keys = list(keys)
    vals = vc.filter(F.col("__v").isNotNull())
    if method == "mode":  # most frequent, smallest value on ties
        c = vals.groupBy(*keys, "__v").agg(F.sum("__w").alias("__n"))
        return c.groupBy(*keys).agg(F.max_by(F.col("__v"), F.struct(F.col("__n"), -F.col("__v"))).alias("__stat"))
    if method == "median":  # exact weighted median (same interpolation as the unweighted one)
        return weighted_percentiles(vals, keys, "__v", "__w", [("__stat", 0.5)], hot_rows, rows)
    raise ValueError(f"unknown fill method: {method}")


def impute_cascade(
    df: DataFrame, col: str, groups: Sequence[Sequence[str]], method: str, out: str | None = None, hot_rows: int = HOT_GROUP_ROWS,
    rows_of: DataFrame | None = None,
) -> DataFrame:
    """Fill NULLs level by level; each level's statistic sees the values filled by earlier levels,
    then a global statistic of the filled column fills the rest.

    The cascade runs on a weighted table ``(group columns, value, count)`` built
    by one partial aggregate: its size is bounded by distinct (groups, value)
    combinations, not rows, so a hot group costs nothing extra and the levels
    never re-read the fact table.  A group of over ``hot_rows`` distinct values has its median found
    by value ranges.  One null-safe join maps the filled values back.  ``rows_of``: the same rows by a
    shorter plan, which the statistics are then taken from.
    """
    out = out or f"{col}_imputed"
    all_keys = list(dict.fromkeys(k for g in groups for k in g))
    vc = (df if rows_of is None else rows_of).groupBy(*all_keys, nan_to_null(col).alias("__v")).agg(F.count(F.lit(1)).alias("__w"))
    vc = materialize(vc.withColumn("__orig_null", F.col("__v").isNull()))
    rows = vc.count()
    for keys in list(groups) + [()]:
        keys = list(keys)
        stat = _weighted_stat(vc, keys, method, rows, hot_rows)
        vc = _null_safe_join(vc, stat, keys) if keys else vc.join(F.broadcast(stat), how="left")
        vc = vc.withColumn("__v", F.coalesce(F.col("__v"), F.col("__stat"))).drop("__stat")
    fills = materialize(vc.filter("__orig_null").select(*all_keys, F.col("__v").alias("__fill")))  # a row a group with NULLs
    joined = _null_safe_join(df, fills, all_keys)
    return joined.withColumn(out, F.coalesce(nan_to_null(col), F.col("__fill"))).drop("__fill")


# C5 ---------------------------------------------------------------------------
def winsorize(
    df: DataFrame,
    cols: Sequence[str] = WINSOR_COLUMNS,
    lo: float = WINSOR_LOW,
    hi: float = WINSOR_HIGH,
    fit_on: Column | None = None,
    log: bool = True,
    rows_of: DataFrame | None = None,
) -> DataFrame:
    """Clip each column at its [lo, hi] quantiles (fitted on ``fit_on`` rows, default all) and add log1p.

    ``rows_of``: the same rows by a shorter plan, which the quantiles are then taken from.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    fit = df if rows_of is None else rows_of
    fit = fit if fit_on is None else fit.filter(fit_on)
    specs = []
    for c in cols:
        specs += [(f"__lo_{c}", c, lo), (f"__hi_{c}", c, hi)]
    bounds = materialize(global_percentiles(fit.select(*cols), specs))  # one row, read whenever the rows are
    out = df.crossJoin(F.broadcast(bounds))
    new = {}
    for c in cols:
        v = nan_to_null(c)
        w = F.when(v.isNotNull(), F.least(F.greatest(v, F.col(f"__lo_{c}")), F.col(f"__hi_{c}")))
        # an all-null fit column has NULL bounds: keep values unchanged
        w = F.when(F.col(f"__lo_{c}").isNull(), v).otherwise(w)
        new[f"{c}_winsor"] = w
    out = out.withColumns(new)
    if log:
        out = out.withColumns({f"log1p_{c}_winsor": F.log1p(F.col(f"{c}_winsor")) for c in cols})
    return out.drop(*[s[0] for s in specs])


def _masked(df: DataFrame) -> DataFrame:
    out = df.withColumns(
        {
            "area_m2_clean": mask(
                "area_m2", F.col("area_missing_or_zero") | F.col("area_too_small") | F.col("area_too_large")
            ),
            "room_count_clean": mask("room_count", F.col("room_missing") | F.col("room_too_large")),
            "household_size_clean": mask("household_size", F.col("household_size_missing_or_zero")),
        }
    )
    return out.withColumn("deposit_per_m2_clean", safe_ratio("deposit_won", "area_m2_clean"))


def add_clean_columns(df: DataFrame, fit_on: Column | None = None, mode: str = "none", rows_of: DataFrame | None = None) -> DataFrame:
    """Masked / imputed / winsorised columns over the flagged table (``mode``: stage boundary before winsorising).

    ``rows_of``: the same rows with the flags by a shorter plan; all statistics are then taken from it, and no
    stage boundary is needed.
    """
    from fairlease.session import materialize

    narrow = None if rows_of is None else _masked(rows_of)
    out = _masked(df)
    out = impute_cascade(out, "room_count_clean", ROOM_GROUPS, "mode", "room_count_imputed", rows_of=narrow)
    out = impute_cascade(out, "household_size_clean", HOUSEHOLD_GROUPS, "median", "household_size_imputed", rows_of=narrow)
    return winsorize(materialize(out, mode) if narrow is None else out, fit_on=fit_on, rows_of=narrow)


# C6 ---------------------------------------------------------------------------
def _kept(df: DataFrame) -> Column:
    return ~F.col("is_exact_duplicate") & ~F.col("area_missing_or_zero") & ~F.col("area_too_small") & ~F.col(
        "area_too_large"
    )


def train_domain(flagged: DataFrame, drop_sale_missing: bool = True) -> DataFrame:
    out = flagged.filter(F.col("is_in_domain_property_type") & _kept(flagged))
    return out.filter(~F.col("sale_feature_missing")) if drop_sale_missing else out


def out_of_domain(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("is_ood_property_type") & _kept(flagged))


def partition_quality(flagged: DataFrame, drop_sale_missing: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flagged, train-domain, out-of-domain)."""
    return flagged, train_domain(flagged, drop_sale_missing), out_of_domain(flagged)


# C7 ---------------------------------------------------------------------------
def training_rows(df: DataFrame, target: str) -> DataFrame:
    if target not in df.columns:
        raise ValueError(f"target column not found: {target}")
    return df.filter(nan_to_null(target).isNotNull())


# E5 ---------------------------------------------------------------------------
def quality_report(raw: DataFrame, flagged: DataFrame, train: DataFrame, ood: DataFrame) -> DataFrame:
    """Long report (section, key, value): row counts, property-type counts incl. NULL, flag counts."""
    def counts(df: DataFrame, section: str) -> DataFrame:
        return df.groupBy("property_type").agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(section).alias("section"), F.coalesce("property_type", F.lit("<null>")).alias("key"), "value"
        )

    tables = (("input", raw), ("train", train), ("ood", ood))
    # one scan a table: the row counts are the sums of the type counts
    by_type = None
    for name, df in tables:
        part = df.groupBy(F.coalesce("property_type", F.lit("<null>")).alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("t"), "key", "value")
        by_type = part if by_type is None else by_type.unionByName(part)
    by_type = materialize(by_type)  # a row a type
    row_names = F.create_map(*[F.lit(x) for x in ("input", "input_rows", "train", "preprocessed_train_rows", "ood", "preprocessed_ood_rows")])
    names = raw.sparkSession.createDataFrame([(n,) for n, _ in tables], "t string")
    rows = names.join(by_type, "t", "left").groupBy("t").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    rows = rows.select(F.lit("rows").alias("section"), row_names[F.col("t")].alias("key"), "value")
    flag_cols = [c for c in FLAG_COLUMNS if c in flagged.columns]
    flags = flagged.agg(F.count(F.lit(1)).alias("flagged_rows"), *[F.count_if(F.col(c)).alias(c) for c in flag_cols])
    entry = lambda section, c: F.struct(F.lit(section).alias("section"), F.lit(c).alias("key"), F.col(c).alias("value"))
    flags = flags.select(F.explode(F.array(entry("rows", "flagged_rows"), *[entry("flag_counts", c) for c in flag_cols])).alias("kv")).select("kv.*")
    types = by_type.select(F.concat(F.lit("property_type_counts_"), F.col("t")).alias("section"), "key", "value")
    return rows.unionByName(types).unionByName(flags)


# C8 ---------------------------------------------------------------------------
# Fixed exclude list: leakage-prone or identifying columns never used as features
# (the reference's list, with its address/type column names mapped to ours).
TARGET = "log1p_lh_vs_rent_median_ratio_winsor"
EXCLUDE_COLUMNS = (
    TARGET,
    "lh_vs_rent_median_ratio",
    "lh_vs_rent_median_ratio_winsor",
    "lh_vs_sale_median_ratio",
    "lh_vs_sale_median_ratio_winsor",
    "log1p_lh_vs_sale_median_ratio_winsor",
    "jeonse_to_sale_ratio_median",
    "jeonse_to_sale_ratio_median_winsor",
    "log1p_jeonse_to_sale_ratio_median_winsor",
    "deposit_per_m2",
    "deposit_per_m2_clean",
    "deposit_per_m2_clean_winsor",
    "log1p_deposit_per_m2_clean_winsor",
    "deposit_won",
    "support_won",
    "support_ratio",
    "support_ratio_low",
    "tenant_deposit_won",
    "monthly_rent_won",
    "lh_vs_sale_ratio_gt_1",
    "jeonse_to_sale_ratio_gt_1",
    "contract_date",
    "address",
    # row identity and split labels are ours
    "row_key",
    "split",
)
NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
CATEGORICAL_COLUMNS = ("gu_code", "gu_name", "ym", "property_type", "housing_type", "detail_type", "cluster_id")


def select_features(df: DataFrame, target: str, exclude: Sequence[str] = EXCLUDE_COLUMNS):
    """(features, categorical, numeric) from the schema; booleans count as numeric, other types are dropped."""
    usable = [c for c in df.columns if c not in exclude and c != target]
    types = dict(df.dtypes)
    cat = [c for c in usable if c in CATEGORICAL_COLUMNS or types[c] == "string"]
    num = [c for c in usable if c not in cat and types[c] in NUMERIC_TYPES or types[c].startswith("decimal")]
    return cat + num, cat, num


COMBO_COLUMNS = ("gu_property", "gu_ym", "property_ym", "housing_type_ym", "detail_type_ym")


def final_features(df: DataFrame, target: str = TARGET):
    """(features, categorical, numeric) of the final model: the selected columns, then the combined keys."""
    feats, cat, num = select_features(df, target)
    combos = [c for c in COMBO_COLUMNS if c in df.columns]
    feats = [c for c in feats if c not in combos] + combos
    cat = [c for c in cat if c not in combos] + combos
    return feats, cat, [c for c in feats if c not in cat]
