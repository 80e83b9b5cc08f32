"""Fixture queries: one per operator, each paired with independent DuckDB SQL.

Each query takes ``(spark, sf_dir)``, reads the whole driver tables and returns
a DataFrame whose columns are aliased exactly like the oracle's.  Averages and
other order-dependent float sums are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlease.operators import market
from fairlease.plans.fixture_sql import with_binding
from fairlease.session import materialize
from fairlease.sources import binding

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

_SHARED: dict = {}


def _shared(name: str, spark, sf, build, mode: str = "checkpoint"):
    """One materialised copy of a shared intermediate per (session, data folder); ``none``: one plan over stored tables."""
    key = (name, id(spark), sf)
    hit = _SHARED.get(key)
    if hit is None or hit[0] is not spark:  # the entry keeps its session alive, so ids are not reused
        hit = (spark, materialize(build(), mode))
        _SHARED[key] = hit
    return hit[1]




def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def _round_cols(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# ---------------------------------------------------------------- phase 1: market
@register(
    "fixture_listings",
    with_binding("select * from listings"),
)
def fixture_listings(spark, sf):
    return _sources(spark, sf)[0]


@register(
    "lease_market_features",
    with_binding(
        "select gu_code, gu_name, ym, property_type, rent_txn_count, jeonse_txn_count, rent_deposit_median,"
        " round(rent_deposit_mean, 2) rent_deposit_mean, rent_deposit_per_m2_median,"
        " round(rent_deposit_per_m2_mean, 4) rent_deposit_per_m2_mean, monthly_rent_median, area_m2_median"
        " from lease_feats"
    ),
)
def lease_market_features_query(spark, sf):
    out = market.lease_market_features(_sources(spark, sf)[1])
    return out.withColumns(
        {"rent_deposit_mean": F.round("rent_deposit_mean", 2), "rent_deposit_per_m2_mean": F.round("rent_deposit_per_m2_mean", 4)}
    )


@register(
    "sale_market_features",
    with_binding(
        "select gu_code, gu_name, ym, property_type, sale_txn_count, sale_price_median,"
        " round(sale_price_mean, 2) sale_price_mean, sale_price_per_m2_median,"
        " round(sale_price_per_m2_mean, 4) sale_price_per_m2_mean, sale_area_m2_median from sale_feats"
    ),
)
def sale_market_features_query(spark, sf):
    out = market.sale_market_features(_sources(spark, sf)[2])
    return out.withColumns(
        {"sale_price_mean": F.round("sale_price_mean", 2), "sale_price_per_m2_mean": F.round("sale_price_per_m2_mean", 4)}
    )


@register(
    "lease_market_features_hash",
    with_binding(
        "select gu_code, gu_name, ym, property_type, rent_txn_count, rent_deposit_median, monthly_rent_median,"
        " area_m2_median from lease_feats"
    ),
)
def lease_market_features_hash_query(spark, sf):
    out = market.lease_market_features(_sources(spark, sf)[1], strategy="hash")
    return out.select("gu_code", "gu_name", "ym", "property_type", "rent_txn_count", "rent_deposit_median",
                      "monthly_rent_median", "area_m2_median")


_MODELING_COLS = (
    "row_key, gu_code, ym, property_type, deposit_won, rent_txn_count, rent_deposit_median, sale_txn_count,"
    " sale_price_median, round(lh_vs_rent_median_ratio, 9) lh_vs_rent_median_ratio,"
    " round(lh_vs_sale_median_ratio, 9) lh_vs_sale_median_ratio,"
    " round(jeonse_to_sale_ratio_median, 9) jeonse_to_sale_ratio_median"
)


def modeling_dataset_query(spark: SparkSession, sf: str) -> DataFrame:
    return market.modeling_dataset(_sources(spark, sf)[0], _sources(spark, sf)[1], _sources(spark, sf)[2])


@register("market_join_ratios", with_binding(f"select {_MODELING_COLS} from modeling"))
def market_join_ratios(spark, sf):
    df = modeling_dataset_query(spark, sf)
    df = _round_cols(df, ["lh_vs_rent_median_ratio", "lh_vs_sale_median_ratio", "jeonse_to_sale_ratio_median"], 9)
    return df.select(
        "row_key", "gu_code", "ym", "property_type", "deposit_won", "rent_txn_count", "rent_deposit_median",
        "sale_txn_count", "sale_price_median", "lh_vs_rent_median_ratio", "lh_vs_sale_median_ratio",
        "jeonse_to_sale_ratio_median",
    )


@register(
    "join_region",
    with_binding(
        "select l.row_key, l.gu_code, r.n_name region_name, r.n_regionkey region_group"
        " from listings l left join (select lpad(cast(n_nationkey as varchar),5,'0') gu_code, n_name, n_regionkey"
        " from nation) r on l.gu_code = r.gu_code"
    ),
)
def join_region_query(spark, sf):
    dim = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("gu_code"),
        F.col("n_name").alias("region_name"),
        F.col("n_regionkey").alias("region_group"),
    )
    return market.join_region(_sources(spark, sf)[0].select("row_key", "gu_code"), dim)


@register(
    "lease_market_medians_hot_path",
    with_binding(
        "select gu_code, gu_name, ym, property_type, rent_deposit_median, rent_deposit_per_m2_median,"
        " monthly_rent_median, area_m2_median from lease_feats"
    ),
)
def lease_market_medians_hot_path(spark, sf):
    """Every market cell treated as hot: the range-partitioned exact median path end to end."""
    from fairlease.operators.quantiles import group_percentiles

    specs = [
        ("rent_deposit_median", "deposit_won", 0.5),
        ("rent_deposit_per_m2_median", "deposit_per_m2", 0.5),
        ("monthly_rent_median", "monthly_rent_won", 0.5),
        ("area_m2_median", "area_m2", 0.5),
    ]
    return group_percentiles(_sources(spark, sf)[1], market.MARKET_KEYS, specs, strategy="auto", hot_rows=0)


# ---------------------------------------------------------------- phase 3: quality, lookups, stats, ranks
from fairlease.operators import lookup, quality, ranks, stats  # noqa: E402
from fairlease.plans import preprocess as pp  # noqa: E402
from fairlease.plans.fixture_sql import with_flagged  # noqa: E402
from fairlease.session import materialize  # noqa: E402

TARGET = quality.TARGET


def _sources(spark, sf):
    """Cleaned fact tables, materialised once (they are re-read by every market statistic)."""
    return (
        _shared("listings", spark, sf, lambda: binding.listings(spark, sf)),
        _shared("leases", spark, sf, lambda: binding.leases(spark, sf)),
        _shared("sales", spark, sf, lambda: binding.sales(spark, sf)),
    )


def _market_rows(spark, sf):
    """Leases and sales with the columns that market statistics read."""
    rent = [*market.MARKET_KEYS, "rent_type", "deposit_won", "deposit_per_m2", "monthly_rent_won", "area_m2"]
    sale = [*market.MARKET_KEYS, "sale_price_won", "sale_price_per_m2", "area_m2"]
    return (
        _shared("lease_values", spark, sf, lambda: binding.leases(spark, sf).select(*rent)),
        _shared("sale_values", spark, sf, lambda: binding.sales(spark, sf).select(*sale)),
    )


def modeling_shared(spark, sf) -> DataFrame:
    """Listings + market features + ratios, materialised once per session and folder."""
    return _shared("modeling", spark, sf, lambda: market.modeling_dataset(*_sources(spark, sf)))


def flagged_query(spark, sf) -> DataFrame:
    """The flagged table feeds several statistics: planned once per session and folder over the stored listings, cells,
    fills and bounds."""
    listings = _shared("listings", spark, sf, lambda: binding.listings(spark, sf))
    return _shared("flagged", spark, sf, lambda: pp.flagged_dataset(listings, *_market_rows(spark, sf)), "none")


_FLAGS = ["is_in_domain_property_type"] + list(quality.FLAG_COLUMNS)


@register("quality_flags", with_flagged(f"select row_key, {', '.join(_FLAGS)} from flagged"))
def quality_flags_query(spark, sf):
    ds = modeling_shared(spark, sf)
    return quality.add_quality_flags(ds, dup_cols=list(pp.CONTENT_COLUMNS)).select("row_key", *_FLAGS)


@register(
    "flag_duplicates",
    with_binding(
        "select row_key, row_number() over (partition by gu_code, ym, property_type, room_count order by row_key) > 1"
        " is_exact_duplicate from listings"
    ),
)
def flag_duplicates_query(spark, sf):
    df = _sources(spark, sf)[0]
    return quality.flag_duplicates(df, ["gu_code", "ym", "property_type", "room_count"], "row_key").select(
        "row_key", "is_exact_duplicate"
    )


_CLEAN_COLS = [
    "area_m2_clean", "room_count_clean", "room_count_imputed", "household_size_clean", "household_size_imputed",
]
_WINSOR_COLS = [f"{c}_winsor" for c in quality.WINSOR_COLUMNS] + [f"log1p_{c}_winsor" for c in quality.WINSOR_COLUMNS]


@register(
    "clean_impute_winsorize",
    with_flagged(
        f"select row_key, {', '.join(_CLEAN_COLS)}, round(deposit_per_m2_clean, 6) deposit_per_m2_clean, "
        + ", ".join(f"round({c}, 9) {c}" for c in _WINSOR_COLS)
        + " from flagged"
    ),
)
def clean_impute_winsorize_query(spark, sf):
    df = flagged_query(spark, sf)
    df = df.withColumn("deposit_per_m2_clean", F.round("deposit_per_m2_clean", 6))
    return _round_cols(df, _WINSOR_COLS, 9).select("row_key", *_CLEAN_COLS, "deposit_per_m2_clean", *_WINSOR_COLS)


@register("train_domain_rows", with_flagged("select row_key, property_type, sale_low_confidence from train_domain"))
def train_domain_rows(spark, sf):
    return quality.train_domain(flagged_query(spark, sf)).select("row_key", "property_type", "sale_low_confidence")


@register("out_of_domain_rows", with_flagged("select row_key, property_type from ood"))
def out_of_domain_rows(spark, sf):
    return quality.out_of_domain(flagged_query(spark, sf)).select("row_key", "property_type")


@register(
    "training_rows",
    with_flagged(f"select row_key, round({TARGET}, 9) target from train_domain where {TARGET} is not null"),
)
def training_rows_query(spark, sf):
    df = quality.training_rows(quality.train_domain(flagged_query(spark, sf)), TARGET)
    return df.select("row_key", F.round(TARGET, 9).alias("target"))


_REPORT_SQL = with_flagged(
    """
, counts(section, df) as (select 1, 1)
select 'rows' section, 'input_rows' key, count(*) value from listings
union all select 'rows', 'flagged_rows', count(*) from flagged
union all select 'rows', 'preprocessed_train_rows', count(*) from train_domain
union all select 'rows', 'preprocessed_ood_rows', count(*) from ood
union all select 'property_type_counts_input', coalesce(property_type, '<null>'), count(*) from listings group by all
union all select 'property_type_counts_train', coalesce(property_type, '<null>'), count(*) from train_domain group by all
union all select 'property_type_counts_ood', coalesce(property_type, '<null>'), count(*) from ood group by all
union all select 'flag_counts', k, v from (unpivot (select """
    + ", ".join(f"count(*) filter (where {c}) {c}" for c in quality.FLAG_COLUMNS)
    + """ from flagged) on """
    + ", ".join(quality.FLAG_COLUMNS)
    + """ into name k value v)
"""
).replace(", counts(section, df) as (select 1, 1)\n", "")


@register("quality_report", _REPORT_SQL)
def quality_report_query(spark, sf):
    fl = flagged_query(spark, sf)
    _, train, ood_df = quality.partition_quality(fl)
    return quality.quality_report(_sources(spark, sf)[0], fl, train, ood_df)


@register(
    "median_lookup",
    with_flagged(
        """
select level, group_cols, key, median, cnt from (
  select 0 level, 'gu_name+property_type+ym' group_cols,
         concat_ws('|', coalesce(gu_name,'__MISSING__'), coalesce(property_type,'__MISSING__'), coalesce(ym,'__MISSING__')) key,
         median(rent_deposit_median) median, count(*) cnt from flagged where rent_deposit_median is not null group by all
  union all select 1, 'gu_name+property_type', concat_ws('|', coalesce(gu_name,'__MISSING__'), coalesce(property_type,'__MISSING__')),
         median(rent_deposit_median), count(*) from flagged where rent_deposit_median is not null group by all
  union all select 2, 'property_type+ym', concat_ws('|', coalesce(property_type,'__MISSING__'), coalesce(ym,'__MISSING__')),
         median(rent_deposit_median), count(*) from flagged where rent_deposit_median is not null group by all
  union all select 3, 'property_type', coalesce(property_type,'__MISSING__'),
         median(rent_deposit_median), count(*) from flagged where rent_deposit_median is not null group by all
  union all select 4, 'gu_name', coalesce(gu_name,'__MISSING__'),
         median(rent_deposit_median), count(*) from flagged where rent_deposit_median is not null group by all
  union all select 5, 'global', '', median(rent_deposit_median), count(*) from flagged where rent_deposit_median is not null
)
"""
    ),
)
def median_lookup_query(spark, sf):
    lk = lookup.build_median_lookup(flagged_query(spark, sf), "rent_deposit_median")
    return lk.select("level", "group_cols", F.array_join("key", "|").alias("key"), "median", "cnt")


_UNSEEN = "none of these"
#: Which of (gu_name, property_type, ym) a variant of a listing asks with a value that no level knows:
#: each variant is answered by another level; 0 keeps the listing's own median, 7 asks an empty lookup.
_UNSEEN_KEYS = ((), (), ("ym",), ("gu_name",), ("gu_name", "ym"), ("property_type", "ym"), ("gu_name", "property_type", "ym"), ())


def _level_sql(n: int, cols: tuple[str, ...]) -> str:
    keys = ", ".join(f"coalesce({c}, '__MISSING__') k_{c}" for c in cols)
    by = ", ".join(f"k_{c}" for c in cols)
    return f"m{n} as materialized (select {by}, median(rent_deposit_median) v from (select {keys}, rent_deposit_median from flagged where rent_deposit_median is not null) group by {by})"


#: ``filled`` needs a table ``asked`` with the keys as ``k_*`` and the median that the row brings.
_MEDIAN_LEVELS_SQL = (
    ", ".join(_level_sql(n, cols) for n, cols in enumerate(lookup.MEDIAN_LEVELS))
    + ", mg as materialized (select median(rent_deposit_median) v from flagged where rent_deposit_median is not null)"
)
_MEDIAN_JOINS_SQL = " ".join(f"left join m{n} on " + " and ".join(f"m{n}.k_{c} = a.k_{c}" for c in cols) for n, cols in enumerate(lookup.MEDIAN_LEVELS))
_MEDIAN_VALUE_SQL = "coalesce(a.rent_deposit_median, m0.v, m1.v, m2.v, m3.v, m4.v, mg.v)"
_MEDIAN_SOURCE_SQL = (
    "case when a.rent_deposit_median is not null then '사용자 입력' when m0.v is not null then '지역+주택구분+계약월' when m1.v is not null then '지역+주택구분'"
    " when m2.v is not null then '주택구분+계약월' when m3.v is not null then '주택구분' when m4.v is not null then '지역' when mg.v is not null then '전체 중위값' else '없음' end"
)

_HIER_SQL = with_flagged(
    f"""
, {_MEDIAN_LEVELS_SQL},
asked as materialized ("""
    + " union all ".join(
        f"select row_key || '#{k}' row_key, "
        + ", ".join(f"'{_UNSEEN}' k_{c}" if c in unseen else f"coalesce({c}, '__MISSING__') k_{c}" for c in ("gu_name", "property_type", "ym"))
        + (", rent_deposit_median" if k == 0 else ", null::double rent_deposit_median")
        + " from flagged"
        for k, unseen in enumerate(_UNSEEN_KEYS[:-1])
    )
    + f""")
select a.row_key, {_MEDIAN_VALUE_SQL} rent_deposit_median, {_MEDIAN_SOURCE_SQL} rent_deposit_median_source
from asked a cross join mg {_MEDIAN_JOINS_SQL}
union all select row_key || '#7', null, '없음' from flagged
"""
)


@register("hierarchical_fill_median", _HIER_SQL)
def hierarchical_fill_median(spark, sf):
    """Rows without a lease market get the first matching level's median and its source; every listing asks
    once for each level."""
    fl = flagged_query(spark, sf)
    fill = lambda asked, lk: lookup.hierarchical_lookup(asked, lk, "median", "rent_deposit_median", "rent_deposit_median_source", keep_existing=True)
    variant = lambda k, unseen: F.struct(
        F.concat("row_key", F.lit(f"#{k}")).alias("row_key"),
        *[(F.lit(_UNSEEN) if c in unseen else F.col(c)).alias(c) for c in ("gu_name", "property_type", "ym")],
        (F.col("rent_deposit_median") if k == 0 else F.lit(None).cast("double")).alias("rent_deposit_median"),
    )
    rows = lambda ks: fl.select(F.explode(F.array(*[variant(k, _UNSEEN_KEYS[k]) for k in ks])).alias("v")).select("v.*")
    known = fill(rows(range(7)), lookup.build_median_lookup(fl, "rent_deposit_median"))
    nothing = fill(rows([7]), lookup.build_median_lookup(fl.where(F.lit(False)), "rent_deposit_median"))
    return known.unionByName(nothing).select("row_key", "rent_deposit_median", "rent_deposit_median_source")


_DESCRIBE_COLS = ["lh_vs_rent_median_ratio_winsor", "deposit_per_m2_clean_winsor"]


@register(
    "describe_scores",
    with_flagged(
        "select property_type, \"column\", count, round(mean, 6) mean, round(std, 6) std, round(min, 9) min,"
        " round(q25, 9) q25, round(q50, 9) q50, round(q75, 9) q75, round(max, 9) max from ("
        + " union all ".join(
            f"select property_type, '{c}' \"column\", count({c}) count, avg({c}) mean, stddev_samp({c}) std, min({c}) min,"
            f" quantile_cont({c}, 0.25) q25, quantile_cont({c}, 0.5) q50, quantile_cont({c}, 0.75) q75, max({c}) max"
            f" from flagged group by property_type"
            for c in _DESCRIBE_COLS
        )
        + ")"
    ),
)
def describe_scores_query(spark, sf):
    d = stats.describe_scores(flagged_query(spark, sf), _DESCRIBE_COLS, by=["property_type"])
    return _round_cols(_round_cols(d, ["mean", "std"], 6), ["min", "q25", "q50", "q75", "max"], 9)


# Fixture predictions: deterministic expressions of listing columns standing in for model outputs.
_PRED_SPARK = {
    "pred_a": lambda: F.col(TARGET) * 0.9 + 0.05,
    "pred_b": lambda: F.col(TARGET) * 0.8 + F.log1p(F.col("area_m2_clean")) / 20.0,
    "pred_c": lambda: (F.col(TARGET) + F.coalesce(F.col("log1p_jeonse_to_sale_ratio_median_winsor"), F.lit(0.0))) / 2.0,
}
_PRED_SQL = {
    "pred_a": f"{TARGET} * 0.9 + 0.05",
    "pred_b": f"{TARGET} * 0.8 + ln(1 + area_m2_clean) / 20.0",
    "pred_c": f"({TARGET} + coalesce(log1p_jeonse_to_sale_ratio_median_winsor, 0.0)) / 2.0",
}
_PREDS_CTE = (
    ", preds as (select row_key, gu_code, gu_name, ym, property_type, rent_deposit_median, deposit_won, area_m2_clean,"
    f" {TARGET} target, "
    + ", ".join(f"{v} {k}" for k, v in _PRED_SQL.items())
    + f" from train_domain where {TARGET} is not null)\n"
)


def preds_query(spark, sf) -> DataFrame:
    tr = quality.training_rows(quality.train_domain(flagged_query(spark, sf)), TARGET)
    return tr.select(
        "row_key", "gu_code", "gu_name", "ym", "property_type", "rent_deposit_median", "deposit_won", "area_m2_clean",
        F.col(TARGET).alias("target"), *[f().alias(k) for k, f in _PRED_SPARK.items()],
    )


@register(
    "regression_metrics",
    with_flagged(
        _PREDS_CTE
        + " union all ".join(
            f"select property_type, '{p}' model, count(*) n, round(sqrt(avg((target - {p})^2)), 9) rmse,"
            f" round(avg(abs(target - {p})), 9) mae,"
            f" round(1 - sum((target - {p})^2) / sum((target - ybar)^2), 9) r2"
            f" from (select *, avg(target) over (partition by property_type) ybar from preds) group by property_type"
            for p in _PRED_SQL
        )
    ),
)
def regression_metrics_query(spark, sf):
    m = stats.regression_metrics(preds_query(spark, sf), "target", list(_PRED_SPARK), by=["property_type"])
    return _round_cols(m, ["rmse", "mae", "r2"], 9)


@register(
    "ratio_metrics",
    with_flagged(
        _PREDS_CTE
        + "select round(sqrt(avg((exp(pred_a) - exp(target))^2)), 9) ratio_rmse,"
        " round(avg(abs(exp(pred_a) - exp(target))), 9) ratio_mae, round(avg(exp(pred_a) - exp(target)), 9) ratio_mean_error from preds"
    ),
)
def ratio_metrics_query(spark, sf):
    return _round_cols(stats.ratio_metrics(preds_query(spark, sf), "target", "pred_a"), ["ratio_rmse", "ratio_mae", "ratio_mean_error"], 9)


@register(
    "robust_stats",
    with_flagged(
        """
, s as (select property_type, count(deposit_per_m2_clean) n, median(deposit_per_m2_clean) median,
        quantile_cont(deposit_per_m2_clean, 0.25) q25, quantile_cont(deposit_per_m2_clean, 0.75) q75,
        stddev_pop(deposit_per_m2_clean) std from flagged group by property_type),
m as (select f.property_type, median(abs(f.deposit_per_m2_clean - s.median)) mad from flagged f
      join s on f.property_type is not distinct from s.property_type group by f.property_type)
select s.property_type, n, round(median, 6) median, round(q25, 6) q25, round(q75, 6) q75,
       round(case when q75 - q25 > 0 then q75 - q25 else std end, 6) iqr, round(std, 6) std, round(mad, 6) mad
from s join m on s.property_type is not distinct from m.property_type
"""
    ),
)
def robust_stats_query(spark, sf):
    r = stats.robust_stats(flagged_query(spark, sf), "deposit_per_m2_clean", by=["property_type"])
    return _round_cols(r, ["median", "q25", "q75", "iqr", "std", "mad"], 6)


@register(
    "correlations",
    with_flagged(
        _PREDS_CTE
        + """
, r as (select (rank() over (order by target) + (count(*) over (partition by target) - 1) / 2.0) ra,
               (rank() over (order by pred_b) + (count(*) over (partition by pred_b) - 1) / 2.0) rb from preds)
select round((select corr(target, pred_b) from preds), 9) pearson, round(corr(ra, rb), 9) spearman from r
"""
    ),
)
def correlations_query(spark, sf):
    c = stats.spearman(preds_query(spark, sf), "target", "pred_b", "row_key")
    return _round_cols(c, ["pearson", "spearman"], 9)


@register(
    "risk_diagnostics",
    with_flagged(
        _PREDS_CTE
        + """
, t as (select quantile_cont(pred_c, 0.25) q25, quantile_cont(pred_c, 0.75) q75 from preds)
select count(*) filter (where pred_c <= q25) low_n, count(*) filter (where pred_c >= q75) high_n,
"""
        + ",\n".join(
            f"round(avg(target - {p}) filter (where pred_c <= q25), 9) low_mean_residual_{p},"
            f" round(avg(abs(target - {p})) filter (where pred_c <= q25), 9) low_mean_abs_residual_{p},"
            f" round(avg(target - {p}) filter (where pred_c >= q75), 9) high_mean_residual_{p},"
            f" round(avg(abs(target - {p})) filter (where pred_c >= q75), 9) high_mean_abs_residual_{p}"
            for p in ("pred_a", "pred_b")
        )
        + " from preds, t"
    ),
)
def risk_diagnostics_query(spark, sf):
    d = stats.risk_diagnostics(preds_query(spark, sf), "pred_c", "target", ["pred_a", "pred_b"])
    return _round_cols(d, [c for c in d.columns if c not in ("low_n", "high_n")], 9)


@register(
    "clipped_histogram",
    with_flagged(
        """
, t as (select quantile_cont(deposit_per_m2_clean, 0.01) lo, quantile_cont(deposit_per_m2_clean, 0.99) hi from flagged),
hb as (select case when (hi - lo) / 60 > 0 then cast(least(floor((least(greatest(deposit_per_m2_clean, lo), hi) - lo) / ((hi - lo) / 60)), 59) as integer) else 0 end bin
      from flagged, t where deposit_per_m2_clean is not null)
select bin, round(lo + bin * (hi - lo) / 60, 6) lo, round(lo + (bin + 1) * (hi - lo) / 60, 6) hi, count(*) count
from hb, t group by bin, t.lo, t.hi
"""
    ),
)
def clipped_histogram_query(spark, sf):
    h = stats.clipped_histogram(flagged_query(spark, sf), "deposit_per_m2_clean", 0.01, 60)
    return _round_cols(h, ["lo", "hi"], 6)


@register(
    "pct_rank_avg",
    with_flagged(
        """
select row_key, round(case when lh_vs_sale_median_ratio_winsor is null then 0.0 else
  (rank() over (order by lh_vs_sale_median_ratio_winsor) + (count(*) over (partition by lh_vs_sale_median_ratio_winsor) - 1) / 2.0)
  / count(lh_vs_sale_median_ratio_winsor) over () end, 12) pct
from flagged
"""
    ),
)
def pct_rank_avg_query(spark, sf):
    r = ranks.pct_rank_avg(flagged_query(spark, sf).select("row_key", "lh_vs_sale_median_ratio_winsor"), "lh_vs_sale_median_ratio_winsor", "pct")
    return r.select("row_key", F.round("pct", 12).alias("pct"))


@register(
    "ref_percentile",
    with_flagged(
        """
, ref as (select deposit_per_m2_clean v from train_domain where deposit_per_m2_clean is not null)
select o.row_key, case when (select count(*) from ref) = 0 then 0.0 when o.deposit_per_m2_clean is null then 1.0
  else round((select count(*) from ref where ref.v <= o.deposit_per_m2_clean) / (select count(*) from ref), 12) end pct
from ood o
"""
    ),
)
def ref_percentile_query(spark, sf):
    fl = flagged_query(spark, sf)
    out = ranks.ref_percentile(quality.out_of_domain(fl).select("row_key", "deposit_per_m2_clean"), "deposit_per_m2_clean",
                               quality.train_domain(fl), "deposit_per_m2_clean", "pct")
    return out.select("row_key", F.round("pct", 12).alias("pct"))


@register(
    "tail_score",
    with_flagged(
        """
, ref as (select deposit_per_m2_clean v from train_domain where deposit_per_m2_clean is not null),
t as (select quantile_cont(v, 0.85) qn, quantile_cont(v, 0.999) qh, count(*) n from ref)
select o.row_key, round(case when o.deposit_per_m2_clean is null or t.n = 0 then 0.0
  when t.qh <= t.qn then least(greatest(100.0 * (select count(*) from ref where ref.v <= o.deposit_per_m2_clean) / t.n, 0), 100)
  else least(greatest((o.deposit_per_m2_clean - t.qn) / (t.qh - t.qn) * 100.0, 0), 100) end, 9) score
from ood o, t
"""
    ),
)
def tail_score_query(spark, sf):
    fl = flagged_query(spark, sf)
    out = ranks.tail_score(quality.out_of_domain(fl).select("row_key", "deposit_per_m2_clean"), "deposit_per_m2_clean",
                           quality.train_domain(fl), "deposit_per_m2_clean", "score")
    return out.select("row_key", F.round("score", 9).alias("score"))


@register(
    "topk_capture",
    with_flagged(
        _PREDS_CTE
        + """
, r as (select row_number() over (order by target desc, row_key) ry, row_number() over (order by pred_b desc, row_key) rr,
               count(*) over () n from preds)
select round(count(*) filter (where ry <= ceil(n * 0.1) and rr <= ceil(n * 0.1)) / max(ceil(n * 0.1)), 12) top_10pct_capture,
       round(count(*) filter (where ry <= ceil(n * 0.2) and rr <= ceil(n * 0.2)) / max(ceil(n * 0.2)), 12) top_20pct_capture
from r
"""
    ),
)
def topk_capture_query(spark, sf):
    c = ranks.topk_capture(preds_query(spark, sf), "target", "pred_b", "row_key")
    return _round_cols(c, ["top_10pct_capture", "top_20pct_capture"], 12)


# ---------------------------------------------------------------- phase 4/5: splits, baselines, scoreboard
from fairlease.operators import splits  # noqa: E402
from fairlease.session import materialize  # noqa: E402

_SPLIT_CTE = """
, grp as (select distinct gu_code, ym, property_type, substr(ym, 1, 4) _year from preds),
g as (select *, row_number() over (partition by _year order by md5(concat_ws('|', '42', coalesce(gu_code, '__MISSING__'),
        coalesce(ym, '__MISSING__'), coalesce(property_type, '__MISSING__'), coalesce(_year, '__MISSING__')))) rn,
        count(*) over (partition by _year) n from grp),
c as (select *, floor(n * 0.7::double) ntr0, floor(n * 0.15::double) nva0 from g),
d as (select *, case when n >= 3 and ntr0 = 0 then 1 else ntr0 end ntr1, case when n >= 3 and nva0 = 0 then 1 else nva0 end nva from c),
e as (select *, case when n >= 3 and n - ntr1 - nva = 0 then greatest(1, ntr1 - 1) else ntr1 end ntr from d),
sm as (select gu_code, ym, property_type, _year,
       case when rn <= ntr then 'train' when rn <= ntr + nva then 'valid' else 'test' end split from e),
sp as (select p.*, sm.split from preds p join sm on p.gu_code is not distinct from sm.gu_code
       and p.ym is not distinct from sm.ym and p.property_type is not distinct from sm.property_type)
"""


def split_preds(spark, sf) -> DataFrame:
    """Fixture predictions with a year-stratified group split label (materialised: read by every consumer)."""
    return _shared("split_preds", spark, sf, lambda: splits.group_split(preds_query(spark, sf))[0])


@register("group_split", with_flagged(_PREDS_CTE + _SPLIT_CTE + "select row_key, split from sp"))
def group_split_query(spark, sf):
    return split_preds(spark, sf).select("row_key", "split")


@register(
    "group_split_report",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + "select _year \"year\", count(*) groups, count(*) filter (where split = 'train') train_groups,"
        " count(*) filter (where split = 'valid') valid_groups, count(*) filter (where split = 'test') test_groups"
        " from sm group by _year"
    ),
)
def group_split_report_query(spark, sf):
    _, report = splits.group_split(preds_query(spark, sf))
    return report


@register(
    "month_folds",
    with_flagged(_PREDS_CTE + "select ym, ntile(5) over (order by ym) - 1 fold from (select distinct ym from preds where ym is not null)"),
)
def month_folds_query(spark, sf):
    return splits.month_folds(preds_query(spark, sf), 5)


@register(
    "sample_per_group",
    with_flagged(
        "select row_key, property_type from (select row_key, property_type, row_number() over (partition by property_type"
        " order by md5(concat_ws('|', '42', coalesce(row_key, '__MISSING__')))) rn from flagged) where rn <= 350"
    ),
)
def sample_per_group_query(spark, sf):
    return splits.sample_per_group(flagged_query(spark, sf), "property_type", 350, 42).select("row_key", "property_type")


@register(
    "sample_global",
    with_flagged("select row_key from (select row_key, row_number() over (order by md5(concat_ws('|', '42', coalesce(row_key, '__MISSING__')))) rn from flagged) where rn <= 15000"),
)
def sample_global_query(spark, sf):
    """15,000 rows of the whole table, the same in every run."""
    return splits.sample_global(flagged_query(spark, sf), 15_000).select("row_key")


def _deviate_sql(salt: str, scale: float) -> str:
    unit = lambda at: f"((('0x' || substr(md5('42|{salt}|' || row_key), {at}, 12))::bigint + 0.5) / 281474976710656.0)"
    return f"{scale} * sqrt(-2.0 * ln({unit(1)})) * cos(2.0 * pi() * {unit(13)})"


@register(
    "plot_points",
    with_flagged(
        f"select row_key, round(area_m2_clean + {_deviate_sql('area', splits.AREA_JITTER)}, 9) x,"
        f" round(greatest(0.0, rent_deposit_median / 100000000.0 + {_deviate_sql('median', splits.MEDIAN_JITTER)}), 9) y, property_type cluster_id"
        " from (select *, row_number() over (partition by property_type order by md5(concat_ws('|', '42', coalesce(row_key, '__MISSING__')))) rn from flagged)"
        " where rn <= 350 and area_m2_clean is not null and rent_deposit_median is not null"
    ),
)
def plot_points_query(spark, sf):
    """Up to 350 plot points a cluster (the property type stands in), with the seeded jitter of their position."""
    return _round_cols(splits.plot_points(flagged_query(spark, sf), "property_type"), ["x", "y"], 9)


@register(
    "union_distinct",
    with_binding("select distinct gu_code, ym, property_type from (select gu_code, ym, property_type from leases"
                 " union all select gu_code, ym, property_type from sales)"),
)
def union_distinct_query(spark, sf):
    a = _sources(spark, sf)[1].select("gu_code", "ym", "property_type")
    b = _sources(spark, sf)[2].select("gu_code", "ym", "property_type")
    return a.unionByName(b).distinct()


@register(
    "median_baseline",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + """
, gm as (select median(target) v from sp where split = 'train'),
grpm as (select gu_code, property_type, median(target) v from sp where split = 'train' group by all)
select s.row_key, s.split, round(gm.v, 12) pred_global_median, round(coalesce(grpm.v, gm.v), 12) pred_gu_property_median
from sp s cross join gm left join grpm on s.gu_code is not distinct from grpm.gu_code
  and s.property_type is not distinct from grpm.property_type
where s.split in ('valid', 'test')
"""
    ),
)
def median_baseline_query(spark, sf):
    sp = split_preds(spark, sf)
    model = lookup.MedianBaseline(("gu_code", "property_type"), "target").fit(sp.filter(F.col("split") == "train"))
    out = model.transform(sp.filter(F.col("split").isin("valid", "test")))
    return _round_cols(out.select("row_key", "split", "pred_global_median", "pred_gu_property_median"),
                       ["pred_global_median", "pred_gu_property_median"], 12)


_INTERVAL_SQL = with_flagged(
    _PREDS_CTE + _SPLIT_CTE + """
, v as (select *, abs(target - pred_a) r from sp where split = 'valid')
select level, group_cols, key, round(q, 12) q, cnt from (
  select 0 level, 'gu_name+property_type' group_cols, concat_ws('|', coalesce(gu_name,'__MISSING__'), coalesce(property_type,'__MISSING__')) key,
         quantile_cont(r, 0.95) q, count(*) cnt from v group by gu_name, property_type having count(*) >= 30
  union all select 1, 'property_type', coalesce(property_type,'__MISSING__'), quantile_cont(r, 0.95), count(*) from v
         group by property_type having count(*) >= 30
  union all select 2, 'gu_name', coalesce(gu_name,'__MISSING__'), quantile_cont(r, 0.95), count(*) from v
         group by gu_name having count(*) >= 30
  union all select 3, 'global', '', quantile_cont(r, 0.95), count(*) from v
)
"""
)


@register("interval_lookup", _INTERVAL_SQL)
def interval_lookup_query(spark, sf):
    v = split_preds(spark, sf).filter(F.col("split") == "valid").withColumn("abs_residual", F.abs(F.col("target") - F.col("pred_a")))
    lk = lookup.build_interval_lookup(v, "abs_residual", alpha=0.05, min_rows=30)
    return lk.select("level", "group_cols", F.array_join("key", "|").alias("key"), F.round("q", 12).alias("q"), "cnt")


def _metric_batch(sp: DataFrame, models, experiment: str, stamp: str) -> DataFrame:
    m = stats.regression_metrics(sp, "target", list(models), by=["split"])
    return m.select(
        F.lit(stamp).alias("updated_at"), F.lit(experiment).alias("experiment"), F.lit("default").alias("run_name"),
        "model", "split", F.round("rmse", 9).alias("rmse"), F.round("mae", 9).alias("mae"), F.round("r2", 9).alias("r2"),
        F.lit("target").alias("target"), F.col("n").alias("rows"),
        F.concat(F.lit("res/"), F.lit(experiment), F.lit("/"), F.col("model")).alias("result_path"), F.lit("").alias("notes"),
    )


def _metric_batch_sql(models, experiment: str, stamp: str, where: str = "") -> str:
    return " union all ".join(
        f"select '{stamp}' updated_at, '{experiment}' experiment, 'default' run_name, '{p}' model, split,"
        f" round(sqrt(avg((target - {p})^2)), 9) rmse, round(avg(abs(target - {p})), 9) mae,"
        f" round(1 - sum((target - {p})^2) / sum((target - ybar)^2), 9) r2, 'target' target, count(*) \"rows\","
        f" 'res/{experiment}/{p}' result_path, '' notes"
        f" from (select *, avg(target) over (partition by split) ybar from sp {where}) group by split"
        for p in models
    )


@register(
    "upsert_scores",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE
        + ", old as (" + _metric_batch_sql(("pred_a", "pred_b"), "fixture", "2026-01-01T00:00:00") + "),"
        + " new as (" + _metric_batch_sql(("pred_b", "pred_c"), "fixture", "2026-01-02T00:00:00",
                                          "where property_type = 'apt'") + "),"
        + """ allr as (select *, 0 b from old union all select *, 1 b from new where split = 'test')
select * exclude (rn, b) from (select *, row_number() over (partition by experiment, run_name, model, split, target order by b desc) rn
from allr) where rn = 1
"""
    ),
)
def upsert_scores_query(spark, sf):
    sp = split_preds(spark, sf)
    old = _metric_batch(sp, ("pred_a", "pred_b"), "fixture", "2026-01-01T00:00:00")
    new = _metric_batch(sp.filter(F.col("property_type") == "apt"), ("pred_b", "pred_c"), "fixture", "2026-01-02T00:00:00")
    return splits.upsert_scores(old, new)


@register(
    "best_run",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + ", s as (" + _metric_batch_sql(("pred_a", "pred_b", "pred_c"), "fixture", "2026-01-01T00:00:00")
        + ") select * from s where split = 'test' order by rmse, mae, r2 desc limit 1"
    ),
)
def best_run_query(spark, sf):
    sp = split_preds(spark, sf)
    return splits.best_run(_metric_batch(sp, ("pred_a", "pred_b", "pred_c"), "fixture", "2026-01-01T00:00:00"), "fixture")


# ---------------------------------------------------------------- phase 2: sources, cleaning, scalar functions
import uuid  # noqa: E402

from fairlease.functions import columns as C  # noqa: E402
from fairlease.operators import clean  # noqa: E402
from fairlease.sources import io  # noqa: E402


def _regions(spark, sf) -> DataFrame:
    """Region dimension from the nation table (code = zero-padded key, name = nation name)."""
    return spark.read.parquet(f"{sf}/nation.parquet").select(
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("gu_code"), F.col("n_name").alias("gu_name")
    )


_ITEM_TAGS = ("sggCd", "dealYear", "dealMonth", "dealDay", "deposit", "monthlyRent", "excluUseAr", "rowKey")


def lease_payloads(spark, sf) -> DataFrame:
    """API-style XML pages built from the bound leases: one payload per (region, month, type, page),
    at most ~1000 items per page (page = hash of the row key over ceil(count / 1000) pages)."""
    les = _sources(spark, sf)[1]
    item = F.concat(
        F.lit("<item><sggCd>"), F.col("gu_code"), F.lit("</sggCd><dealYear>"), F.year("contract_date").cast("string"),
        F.lit("</dealYear><dealMonth>"), F.month("contract_date").cast("string"), F.lit("</dealMonth><dealDay>"),
        F.dayofmonth("contract_date").cast("string"), F.lit("</dealDay><deposit> "), F.format_number(F.col("deposit_won") / 10000, 4),
        F.lit(" </deposit><monthlyRent>"), F.format_number(F.col("monthly_rent_won") / 10000, 4),
        F.lit("</monthlyRent><excluUseAr>"), F.col("area_m2").cast("string"), F.lit("</excluUseAr><rowKey>"), F.col("row_key"),
        F.lit("</rowKey></item>"),
    )
    keys = ["gu_code", "ym", "property_type"]
    counts = les.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_count"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_count") / io.PAGE_ROWS))
    paged = les.join(counts, keys).withColumn("page_no", F.pmod(F.xxhash64("row_key"), pages) + 1)
    grouped = paged.groupBy(*keys, "page_no", "total_count").agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    payload = F.concat(
        F.lit("<response><header><resultCode>000</resultCode><resultMsg>OK</resultMsg></header><body><items>"),
        F.col("items"), F.lit("</items><totalCount>"), F.col("total_count").cast("string"), F.lit("</totalCount></body></response>"),
    )
    return grouped.select(
        F.concat(F.lit("rent_"), F.col("property_type")).alias("source_api"), F.col("gu_code").alias("request_gu_code"),
        F.regexp_replace("ym", "-", "").alias("request_deal_ymd"), "property_type", "page_no", payload.alias("payload"),
    )


_LEASE_CHECK_SQL = with_binding(
    "select row_key, gu_code, gu_name, ym, contract_date, property_type, round(deposit_won, 2) deposit_won,"
    " round(monthly_rent_won, 2) monthly_rent_won, area_m2, rent_type, round(deposit_per_m2, 4) deposit_per_m2 from leases"
)


def _lease_check(df: DataFrame) -> DataFrame:
    return df.select(
        "row_key", "gu_code", "gu_name", "ym", "contract_date", "property_type", F.round("deposit_won", 2).alias("deposit_won"),
        F.round("monthly_rent_won", 2).alias("monthly_rent_won"), "area_m2", "rent_type",
        F.round("deposit_per_m2", 4).alias("deposit_per_m2"),
    )


@register("xml_parse_clean_leases", _LEASE_CHECK_SQL)
def xml_parse_clean_leases(spark, sf):
    """A4 + B14: parse API XML pages to rows, stamp the request, clean to typed leases."""
    keep = ("source_api", "request_gu_code", "request_deal_ymd", "property_type")
    rows, _errors = io.parse_trade_xml(lease_payloads(spark, sf), "payload", keep)
    raw = io.item_columns(rows, _ITEM_TAGS, keep).withColumnRenamed("rowKey", "row_key")
    return _lease_check(clean.clean_leases(raw, _regions(spark, sf), binding.START_YM, binding.END_YM))


_FAULTS_SQL = with_binding(
    """
, reqs as (select distinct gu_code, replace(ym, '-', '') deal_ymd, property_type from leases),
told as (select *, (cast(right(gu_code, 2) as bigint) + cast(deal_ymd as bigint)) % 6 fault from reqs)
select 'rent_' || property_type source_api, gu_code request_gu_code, deal_ymd request_deal_ymd,
  case fault when 1 then '03' when 2 then '30' when 3 then 'MALFORMED' when 4 then 'MALFORMED' else 'EMPTY' end result_code,
  case fault when 1 then 'NODATA' when 2 then 'SERVICE_KEY_IS_NOT_REGISTERED_ERROR' end result_msg, fault <> 5 has_payload
from told where fault > 0
"""
)


def faulty_payloads(spark, sf) -> DataFrame:
    """One lease page per request, five of six spoilt: an API error in the header, a service error
    envelope, a truncated body, a body that is no XML, and none at all (by a rule on the request key)."""
    p = lease_payloads(spark, sf)
    fault = (F.substring("request_gu_code", 4, 2).cast("bigint") + F.col("request_deal_ymd").cast("bigint")) % 6
    header = F.lit("<response><header><resultCode>03</resultCode><resultMsg>NODATA</resultMsg></header></response>")
    service = F.lit(
        "<OpenAPI_ServiceResponse><cmmMsgHeader><errMsg>SERVICE ERROR</errMsg>"
        "<returnAuthMsg>SERVICE_KEY_IS_NOT_REGISTERED_ERROR</returnAuthMsg><returnReasonCode>30</returnReasonCode></cmmMsgHeader></OpenAPI_ServiceResponse>"
    )
    cut = F.expr("substr(payload, 1, length(payload) div 2)")
    spoilt = F.when(fault == 0, F.col("payload")).when(fault == 1, header).when(fault == 2, service).when(fault == 3, cut).when(fault == 4, F.lit("upstream timed out"))
    return p.withColumn("payload", spoilt)


@register("xml_payload_errors", _FAULTS_SQL)
def xml_payload_errors(spark, sf):
    """A4 error routing: every spoilt page lands in the error frame with its code and payload."""
    keep = ("source_api", "request_gu_code", "request_deal_ymd")
    _rows, errors = io.parse_trade_xml(faulty_payloads(spark, sf), "payload", keep)
    pages = errors.groupBy(*keep, "result_code").agg(F.max("result_msg").alias("result_msg"), F.max(F.col("payload").isNotNull()).alias("has_payload"))
    return pages.withColumn("result_msg", F.when(~F.col("result_code").isin("MALFORMED", "EMPTY"), F.col("result_msg")))


@register("csv_families_roundtrip", _LEASE_CHECK_SQL)
def csv_families_roundtrip(spark, sf):
    """A9 write + A2 read: two CSV families with different headers (area tag differs), aligned by name."""
    les = _sources(spark, sf)[1]
    base = io.shared_path(spark, "raw", uuid.uuid4().hex)
    common = [
        F.col("gu_code").alias("sggCd"), F.year("contract_date").alias("dealYear"), F.month("contract_date").alias("dealMonth"),
        F.dayofmonth("contract_date").alias("dealDay"), (F.col("deposit_won") / 10000).alias("deposit"),
        (F.col("monthly_rent_won") / 10000).alias("monthlyRent"), "property_type", F.col("row_key").alias("rowKey"),
    ]
    apt_like = F.col("property_type").isin("apt", "officetel")
    io.write_table(les.filter(apt_like).select(*common, F.col("area_m2").alias("excluUseAr")), f"{base}/rent_a.csv", fmt="csv")
    io.write_table(
        les.filter(~apt_like | F.col("property_type").isNull()).select(*common, F.col("area_m2").alias("totalFloorAr"), F.lit("2y").alias("contractTerm")),
        f"{base}/rent_b.csv", fmt="csv",
    )
    raw = io.read_raw_trades(spark, base, "rent").withColumnRenamed("rowKey", "row_key")
    return _lease_check(clean.clean_leases(raw, _regions(spark, sf), binding.START_YM, binding.END_YM))


_MANIFEST_SQL = with_binding(
    """
, cat(source_api, trade_type, property_type) as (values ('rent_apt','rent','apt'), ('rent_rh','rent','rh'),
  ('rent_officetel','rent','officetel'), ('rent_detached','rent','detached'), ('sale_apt','sale','apt'), ('sale_rh','sale','rh'),
  ('sale_officetel','sale','officetel'), ('sale_detached','sale','detached')),
months as (select strftime(m, '%Y%m') deal_ymd from range(date '1995-01-01', date '2002-01-01', interval 1 month) t(m)),
regs as (select lpad(cast(n_nationkey as varchar), 5, '0') gu_code from nation),
man as (select * from cat, regs, months),
tot as (select trade_type, property_type, gu_code, replace(ym, '-', '') deal_ymd, count(*) total_count from (
          select 'rent' trade_type, property_type, gu_code, ym from leases union all
          select 'sale', property_type, gu_code, ym from sales) group by all),
pages as (select man.source_api, man.gu_code, man.deal_ymd, coalesce(tot.total_count, 0) total_count,
          cast(greatest(1, ceil(coalesce(tot.total_count, 0) / 1000)) as bigint) n_pages from man left join tot
          on man.trade_type = tot.trade_type and man.property_type = tot.property_type and man.gu_code = tot.gu_code
          and man.deal_ymd = tot.deal_ymd)
"""
)


def manifest_pages(spark, sf) -> DataFrame:
    man = io.collection_manifest(_regions(spark, sf), binding.START_YM, binding.END_YM)
    tot = (
        _sources(spark, sf)[1].select(F.lit("rent").alias("trade_type"), "property_type", "gu_code", "ym")
        .unionByName(_sources(spark, sf)[2].select(F.lit("sale").alias("trade_type"), "property_type", "gu_code", "ym"))
        .groupBy("trade_type", "property_type", "gu_code", F.regexp_replace("ym", "-", "").alias("deal_ymd"))
        .agg(F.count(F.lit(1)).alias("total_count"))
    )
    j = man.join(tot, ["trade_type", "property_type", "gu_code", "deal_ymd"], "left").withColumn(
        "total_count", F.coalesce("total_count", F.lit(0))
    )
    return io.expand_pages(j, "total_count")


@register(
    "collection_manifest_pages",
    _MANIFEST_SQL + " select source_api, gu_code, deal_ymd, total_count, p page_no from pages, generate_series(1, n_pages) s(p)",
)
def collection_manifest_pages(spark, sf):
    return manifest_pages(spark, sf).select("source_api", "gu_code", "deal_ymd", "total_count", "page_no")


@register(
    "pending_requests",
    _MANIFEST_SQL + """
, have as (select distinct 'rent_' || property_type source_api, gu_code, replace(ym, '-', '') deal_ymd from leases)
select m.source_api, m.gu_code, m.deal_ymd from man m
where not exists (select 1 from have h where h.source_api = m.source_api and h.gu_code = m.gu_code and h.deal_ymd = m.deal_ymd)
""",
)
def pending_requests(spark, sf):
    """Requests whose output already exists (parsed lease pages) are skipped."""
    man = io.collection_manifest(_regions(spark, sf), binding.START_YM, binding.END_YM)
    keep = ("source_api", "request_gu_code", "request_deal_ymd")
    rows, _ = io.parse_trade_xml(lease_payloads(spark, sf), "payload", keep)
    have = rows.select("source_api", F.col("request_gu_code").alias("gu_code"), F.col("request_deal_ymd").alias("deal_ymd"))
    return io.pending(man, have, ["source_api", "gu_code", "deal_ymd"]).select("source_api", "gu_code", "deal_ymd")


@register(
    "stamp_provenance",
    _MANIFEST_SQL + " select m.source_api, m.trade_type, m.property_type, m.gu_code request_gu_code, m.deal_ymd request_deal_ymd from man m",
)
def stamp_provenance_query(spark, sf):
    """A5: catalogue attributes joined onto requests by API name (broadcast catalogue)."""
    man = io.collection_manifest(_regions(spark, sf), binding.START_YM, binding.END_YM).select("source_api", "gu_code", "deal_ymd")
    out = io.stamp_provenance(man, region_col="gu_code", month_col="deal_ymd")
    return out.select("source_api", "trade_type", "property_type", "request_gu_code", "request_deal_ymd")


_SCALAR_SQL = with_binding(
    """
, s as (
  select row_key,
    case when household_size is null then '경기도 성남시 ' else '서울특별시 강남구 ' end || gu_name address,
    replace(format('{:,.2f}', deposit_won), ' ', '') num_text,
    year(contract_date) y, month(contract_date) m, day(contract_date) + case when household_size is null then 20 else 0 end d,
    * exclude (row_key)
  from listings
)
select row_key,
  try_cast(nullif(trim(replace(num_text, ',', '')), '') as double) parsed_deposit,
  nullif(regexp_extract(address, '서울특별시\\s+([가-힣]+구)', 1), '') region,
  case when d <= day(last_day(make_date(y, m, 1))) then make_date(y, m, d) end assembled_date,
  strftime(contract_date, '%Y-%m') month_key, substr(ym, 1, 4) year_of_month,
  support_won / nullif(tenant_deposit_won, 0) support_to_tenant,
  case when coalesce(monthly_rent_won, 0) = 0 then 'jeonse' else 'monthly' end lease_kind,
  concat_ws('__', coalesce(gu_name, '__MISSING__'), coalesce(property_type, '__MISSING__')) gu_property,
  concat_ws('__', coalesce(property_type, '__MISSING__'), coalesce(ym, '__MISSING__')) property_ym,
  concat_ws('__', coalesce(housing_type, '__MISSING__'), coalesce(ym, '__MISSING__')) housing_type_ym,
  round(ln(1 + greatest(tenant_deposit_won / 1e6 - 1, 0)), 9) log_tenant,
  coalesce(cast(room_count as varchar), '__MISSING__') room_key,
  case when area_m2 / 4 >= 80 then '매우 높음' when area_m2 / 4 >= 60 then '높음' when area_m2 / 4 >= 40 then '보통'
       when area_m2 / 4 >= 20 then '낮음' else '매우 낮음' end grade,
  case when area_m2 / 4 >= 80 then 'high_risk' when area_m2 / 4 >= 60 then 'caution' when area_m2 / 4 >= 40 then 'monitor'
       else 'low' end risk_label_training,
  case when area_m2 / 4 >= 80 then 'high_risk' when area_m2 / 4 >= 60 then 'caution' when area_m2 / 4 >= 40 then 'fair'
       else 'safe' end risk_label_scoring,
  case when property_type in ('apt','rh','officetel','detached') then 0 else 75 end model_scope_score,
  case when property_type in ('apt','rh','officetel','detached') then 'in_domain' else 'out_of_domain' end model_scope_status,
  case when area_m2 is null then null else least(greatest(area_m2, 5.0), 150.0) end area_clipped
from s
"""
)


@register("scalar_functions", _SCALAR_SQL)
def scalar_functions(spark, sf):
    """B1, B3, B6, B7, B10, B12, B16-B20, B23 on every listing."""
    df = _sources(spark, sf)[0]
    df = df.withColumns(
        {
            "address": F.concat(
                F.when(F.col("household_size").isNull(), F.lit("경기도 성남시 ")).otherwise(F.lit("서울특별시 강남구 ")), F.col("gu_name")
            ),
            "num_text": F.format_number("deposit_won", 2),
            "_d": F.dayofmonth("contract_date") + F.when(F.col("household_size").isNull(), 20).otherwise(0),
        }
    )
    df = C.add_combo_features(df)
    score = F.col("area_m2") / 4
    df = C.model_scope(df)
    return df.select(
        "row_key",
        C.to_number("num_text").alias("parsed_deposit"),
        C.extract_region("address").alias("region"),
        C.assemble_date(F.year("contract_date"), F.month("contract_date"), F.col("_d")).alias("assembled_date"),
        C.month_key("contract_date").alias("month_key"),
        C.year_of_month("ym").alias("year_of_month"),
        C.safe_ratio("support_won", "tenant_deposit_won").alias("support_to_tenant"),
        C.lease_kind("monthly_rent_won").alias("lease_kind"),
        "gu_property", "property_ym", "housing_type_ym",
        F.round(C.log1p_clipped(F.col("tenant_deposit_won") / 1e6 - 1), 9).alias("log_tenant"),
        C.norm_key("room_count").alias("room_key"),
        C.band(score, C.GRADE_BANDS).alias("grade"),
        C.band(score, C.RISK_BANDS_TRAINING).alias("risk_label_training"),
        C.band(score, C.RISK_BANDS_SCORING).alias("risk_label_scoring"),
        "model_scope_score", "model_scope_status",
        C.clip("area_m2", 5, 150).alias("area_clipped"),
    )


# ---------------------------------------------------------------- phase 5: ensembles, risk
from fairlease.functions.columns import row_std  # noqa: E402
from fairlease.operators import ensemble, risk  # noqa: E402


def _split(spark, sf, name):
    return split_preds(spark, sf).filter(F.col("split") == name)


@register(
    "price_risk_outputs",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + """
, t as (select *, exp(pred_a) - 1 r from sp where split = 'test'),
p as (select *, (rank() over (order by r) + (count(*) over (partition by r) - 1) / 2.0) / count(r) over () pct from t)
select row_key, round(r, 12) predicted_ratio_a, round(pct, 12) predicted_ratio_percentile_a,
  round(rent_deposit_median * r, 4) predicted_fair_deposit_won_a, round(deposit_won - rent_deposit_median * r, 4) deposit_gap_won_a,
  round(deposit_won / nullif(rent_deposit_median * r, 0), 9) deposit_gap_ratio_a, round(100 * pct, 9) risk_judgment_index_a,
  case when 100 * pct >= 80 then 'high_risk' when 100 * pct >= 60 then 'caution' when 100 * pct >= 40 then 'monitor' else 'low' end risk_label_a
from p
"""
    ),
)
def price_risk_outputs(spark, sf):
    out = risk.add_price_risk(_split(spark, sf, "test"), ["pred_a"])
    return out.select(
        "row_key", F.round("predicted_ratio_a", 12).alias("predicted_ratio_a"),
        F.round("predicted_ratio_percentile_a", 12).alias("predicted_ratio_percentile_a"),
        F.round("predicted_fair_deposit_won_a", 4).alias("predicted_fair_deposit_won_a"),
        F.round("deposit_gap_won_a", 4).alias("deposit_gap_won_a"), F.round("deposit_gap_ratio_a", 9).alias("deposit_gap_ratio_a"),
        F.round("risk_judgment_index_a", 9).alias("risk_judgment_index_a"), "risk_label_a",
    )


_STD_SQL = "sqrt(((pred_a - (pred_a + pred_b + pred_c) / 3) ^ 2 + (pred_b - (pred_a + pred_b + pred_c) / 3) ^ 2 + (pred_c - (pred_a + pred_b + pred_c) / 3) ^ 2) / 2)"
_DISAGREE_CTE = f"""
, vd as (select {_STD_SQL} d from sp where split = 'valid'),
td as (select row_key, {_STD_SQL} d from sp where split = 'test')
"""


@register(
    "model_disagreement",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + _DISAGREE_CTE + """
select row_key, round(d, 12) model_disagreement_score,
  round(case when (select count(*) from vd where d is not null) = 0 then 0.0 when d is null then 1.0
        else (select count(*) from vd where vd.d <= td.d) / (select count(*) from vd where d is not null) end, 12) model_disagreement_percentile
from td
"""
    ),
)
def model_disagreement_query(spark, sf):
    out = risk.model_disagreement(_split(spark, sf, "valid"), _split(spark, sf, "test"), ["pred_a", "pred_b", "pred_c"])
    return out.select("row_key", F.round("model_disagreement_score", 12).alias("model_disagreement_score"),
                      F.round("model_disagreement_percentile", 12).alias("model_disagreement_percentile"))


_UNSUP_CTE = """
, uv as (select * from sp where split = 'valid'), ut as (select * from sp where split = 'test'),
st as (select median(area_m2_clean) ca, case when quantile_cont(area_m2_clean, 0.75) - quantile_cont(area_m2_clean, 0.25) > 1e-9
         then quantile_cont(area_m2_clean, 0.75) - quantile_cont(area_m2_clean, 0.25) else stddev_pop(area_m2_clean) + 1e-9 end sa,
         median(pred_c) cc, case when quantile_cont(pred_c, 0.75) - quantile_cont(pred_c, 0.25) > 1e-9
         then quantile_cont(pred_c, 0.75) - quantile_cont(pred_c, 0.25) else stddev_pop(pred_c) + 1e-9 end sc from uv),
zv as (select uv.*, coalesce((area_m2_clean - ca) / sa, 0) + coalesce((pred_c - cc) / sc, 0) s from uv, st),
zt as (select ut.*, coalesce((area_m2_clean - ca) / sa, 0) + coalesce((pred_c - cc) / sc, 0) s from ut, st),
fs as (select median(s) c, case when quantile_cont(s, 0.75) - quantile_cont(s, 0.25) > 1e-9 then quantile_cont(s, 0.75) - quantile_cont(s, 0.25)
         else stddev_pop(s) + 1e-9 end k from zv),
rv as (select zv.*, least(greatest((s - c) / k, -5.0), 5.0) u from zv, fs),
rt as (select zt.*, (s - c) / k u_raw, least(greatest((s - c) / k, -5.0), 5.0) u from zt, fs)
"""


@register(
    "unsupervised_risk",
    with_flagged(_PREDS_CTE + _SPLIT_CTE + _UNSUP_CTE + "select row_key, round(u_raw, 9) unsupervised_risk_score_raw, round(u, 9) unsupervised_risk_score from rt"),
)
def unsupervised_risk_query(spark, sf):
    _, t = risk.unsupervised_risk(_split(spark, sf, "valid"), _split(spark, sf, "test"), ["area_m2_clean", "pred_c"])
    return t.select("row_key", F.round("unsupervised_risk_score_raw", 9).alias("unsupervised_risk_score_raw"),
                    F.round("unsupervised_risk_score", 9).alias("unsupervised_risk_score"))


@register(
    "risk_index",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + _DISAGREE_CTE + _UNSUP_CTE + """
, vr as (select exp(pred_a) - 1 r from sp where split = 'valid'),
k as (select t.row_key, t.deposit_won, t.rent_deposit_median, exp(t.pred_a) - 1 r,
        (select count(*) from vd where vd.d <= td.d) / (select count(*) from vd) dp,
        (select count(*) from rv where rv.u <= rt.u) / (select count(*) from rv) up
      from sp t join td on t.row_key = td.row_key join rt on t.row_key = rt.row_key),
k2 as (select *, (select count(*) from vr where vr.r <= k.r) / (select count(*) from vr) rp from k),
k3 as (select *, 100 * (0.85 * rp + 0.15 * dp) i1, 100 * (0.60 * rp + 0.30 * up + 0.10 * dp) i2 from k2)
select row_key, round(i1, 9) risk_judgment_index_a, round(i2, 9) risk_judgment_index_unsupervised_a,
  case when i1 >= 80 then 'high_risk' when i1 >= 60 then 'caution' when i1 >= 40 then 'monitor' else 'low' end risk_label_a,
  case when i2 >= 80 then 'high_risk' when i2 >= 60 then 'caution' when i2 >= 40 then 'monitor' else 'low' end risk_label_unsupervised_a,
  round(rent_deposit_median * r, 4) predicted_fair_deposit_won_a
from k3
"""
    ),
)
def risk_index_query(spark, sf):
    v, t = risk.unsupervised_risk(_split(spark, sf, "valid"), _split(spark, sf, "test"), ["area_m2_clean", "pred_c"])
    out = risk.risk_index(v, t, "pred_a", ["pred_a", "pred_b", "pred_c"])
    return out.select(
        "row_key", F.round("risk_judgment_index_a", 9).alias("risk_judgment_index_a"),
        F.round("risk_judgment_index_unsupervised_a", 9).alias("risk_judgment_index_unsupervised_a"),
        "risk_label_a", "risk_label_unsupervised_a", F.round("predicted_fair_deposit_won_a", 4).alias("predicted_fair_deposit_won_a"),
    )


def _risk_report_sql() -> str:
    bases = ("a", "b")
    ratio = ", ".join(f"(select count(*) from v{b} where v{b}.r <= exp(t.pred_{b}) - 1) / (select count(*) from v{b}) p{b}" for b in bases)
    index = {f"{u}{b}": (f"100 * (0.60 * p{b} + 0.30 * up + 0.10 * dp)" if u else f"100 * (0.85 * p{b} + 0.15 * dp)") for b in bases for u in ("", "unsupervised_")}
    arms = []
    for name, formula in index.items():
        b = name[-1]
        arms.append(
            f"select '{name}' variant, 'pred_{b}' base, row_key, target y, pred_{b} p, {formula} i from k"
        )
    rank = lambda c: f"rank() over (partition by variant order by {c}) + (count(*) over (partition by variant, {c}) - 1) / 2.0"
    top = lambda c: f"row_number() over (partition by variant order by {c} desc, row_key)"
    return f"""
, {", ".join(f"v{b} as (select exp(pred_{b}) - 1 r from sp where split = 'valid')" for b in bases)},
k as materialized (select t.row_key, t.target, t.pred_a, t.pred_b, {ratio},
        (select count(*) from vd where vd.d <= td.d) / (select count(*) from vd) dp,
        (select count(*) from rv where rv.u <= rt.u) / (select count(*) from rv) up
      from sp t join td on t.row_key = td.row_key join rt on t.row_key = rt.row_key),
long as materialized ({" union all ".join(arms)}),
ranked as (select *, {rank("y")} ry, {rank("i")} ri, {top("y")} ty, {top("i")} ti, count(*) over (partition by variant) m from long)
select variant, base, count(*) n, round(sqrt(avg((y - p) ^ 2)), 9) rmse, round(avg(abs(y - p)), 9) mae, round(1 - sum((y - p) ^ 2) / (var_pop(y) * count(y)), 9) r2,
  round(corr(y, i), 9) risk_pearson, round(corr(ry, ri), 9) risk_spearman,
  round(count(*) filter (ty <= ceil(m * 0.1) and ti <= ceil(m * 0.1)) / ceil(any_value(m) * 0.1), 9) top10_capture_rate,
  round(count(*) filter (ty <= ceil(m * 0.2) and ti <= ceil(m * 0.2)) / ceil(any_value(m) * 0.2), 9) top20_capture_rate
from ranked group by variant, base
"""


@register("risk_report", with_flagged(_PREDS_CTE + _SPLIT_CTE + _DISAGREE_CTE + _UNSUP_CTE + _risk_report_sql()))
def risk_report_query(spark, sf):
    """K3: two bases, each without and with the unsupervised score; prediction metrics and how the index follows the target."""
    v, t = risk.unsupervised_risk(_split(spark, sf, "valid"), _split(spark, sf, "test"), ["area_m2_clean", "pred_c"])
    bases = ["pred_a", "pred_b"]
    out = risk.risk_report(risk.risk_index(v, t, bases, ["pred_a", "pred_b", "pred_c"]), bases)
    return _round_cols(out, [c for c in out.columns if c not in ("variant", "base", "n")], 9)


@register(
    "ensemble_equal",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + "select row_key, round(0.0 + pred_a * (1.0/3) + pred_b * (1.0/3) + pred_c * (1.0/3), 9) pred_ensemble_equal,"
        " round(target - (0.0 + pred_a * (1.0/3) + pred_b * (1.0/3) + pred_c * (1.0/3)), 9) residual_ensemble_equal from sp where split = 'test'"
    ),
)
def ensemble_equal_query(spark, sf):
    t = _split(spark, sf, "test")
    out = ensemble.add_ensembles(t, ["pred_a", "pred_b", "pred_c"], {"pred_a": 1, "pred_b": 1, "pred_c": 1})
    return out.select("row_key", F.round("pred_ensemble_equal", 9).alias("pred_ensemble_equal"),
                      F.round("residual_ensemble_equal", 9).alias("residual_ensemble_equal"))


@register("simplex_weights", None)
def simplex_weights_query(spark, sf):
    """I9 (iterative fit, rows-only): weights fitted on valid; tests check simplex + optimality."""
    w = ensemble.fit_simplex_weights(_split(spark, sf, "valid"), ["pred_a", "pred_b", "pred_c"])
    return spark.createDataFrame(sorted(w.items()), "model string, weight double")


@register("ridge_stack", None)
def ridge_stack_query(spark, sf):
    """I6/I7 (LOO alpha search, rows-only): ridge meta-model fit on valid, test predictions scored."""
    out, _rep = ensemble.stack_saved(_split(spark, sf, "valid"), _split(spark, sf, "test"), ["pred_a", "pred_b", "pred_c"])
    return out.select("row_key", "stacking_pred", "stacking_residual")


@register(
    "align_predictions",
    with_flagged(_PREDS_CTE + _SPLIT_CTE + "select row_key, target, pred_a, pred_b, pred_c from sp where split = 'test'"),
)
def align_predictions_query(spark, sf):
    t = _split(spark, sf, "test")
    frames = {
        "a": t.select("row_key", "target", "pred_a"),
        "b": t.select("row_key", "target", F.col("pred_b").alias("b_pred")),
        "c": ensemble.select_predictions(t, ["c"]),
    }
    return ensemble.align_predictions(frames).select("row_key", "target", "pred_a", "pred_b", "pred_c")


_VAL_SQL = with_flagged(
    _PREDS_CTE + _SPLIT_CTE + """
, v as (select *, abs(target - pred_a) r from sp where split = 'valid'),
l0 as (select gu_name, property_type, quantile_cont(r, 0.95) q from v group by all having count(*) >= 30),
l1 as (select property_type, quantile_cont(r, 0.95) q from v group by all having count(*) >= 30),
l2 as (select gu_name, quantile_cont(r, 0.95) q from v group by all having count(*) >= 30),
gq as (select quantile_cont(r, 0.95) q from v),
t as (select s.*, coalesce(l0.q, l1.q, l2.q, gq.q) q,
        case when l0.q is not null then '지역+주택구분' when l1.q is not null then '주택구분' when l2.q is not null then '지역'
             else '전체 중위값' end src
      from sp s cross join gq
      left join l0 on s.gu_name = l0.gu_name and s.property_type = l0.property_type
      left join l1 on s.property_type = l1.property_type
      left join l2 on s.gu_name = l2.gu_name where s.split = 'test'),
u as (select *, exp(pred_a) - 1 pr, exp(pred_a - q) - 1 lo, exp(pred_a + q) - 1 hi from t),
w as (select *, rent_deposit_median * pr fair, rent_deposit_median * hi upper from u),
x as (select *, deposit_won / nullif(fair, 0) fr, deposit_won / nullif(upper, 0) ur from w),
y as (select *, coalesce(case when fr is null then null else least(greatest((fr - 1.05) / 0.25 * 100, 0.0), 100.0) end, 0.0) hs,
        coalesce(case when fr is null then null else least(greatest((0.85 - fr) / 0.30 * 100, 0.0), 100.0) end, 0.0) ls,
        coalesce(case when ur is null then null else least(greatest((ur - 1.0) / 0.20 * 100, 0.0), 100.0) end, 0.0) us from x)
select row_key, round(q, 12) interval_q, src interval_source, round(lo, 12) predicted_ratio_lower_95, round(hi, 12) predicted_ratio_upper_95,
  round(rent_deposit_median * lo, 4) fair_deposit_lower_95_won, round(upper, 4) fair_deposit_upper_95_won,
  round(hs, 9) high_price_score, round(ls, 9) low_price_score, round(greatest(hs, ls, us), 9) overprice_score
from y
"""
)


@register("interval_price_score", _VAL_SQL)
def interval_price_score(spark, sf):
    """E4 + D6 + K5 + K6: conformal half-width by hierarchy, 95 % bounds, over/under-price scores."""
    v = _split(spark, sf, "valid").withColumn("abs_residual", F.abs(F.col("target") - F.col("pred_a")))
    lk = lookup.build_interval_lookup(v, "abs_residual")
    t = _split(spark, sf, "test")
    t = lookup.hierarchical_lookup(t, lk, "q", "interval_q", "interval_source")
    t = risk.price_score(risk.prediction_interval(t.withColumn("predicted_log_ratio", F.col("pred_a"))))
    return t.select(
        "row_key", F.round("interval_q", 12).alias("interval_q"), "interval_source",
        F.round("predicted_ratio_lower_95", 12).alias("predicted_ratio_lower_95"), F.round("predicted_ratio_upper_95", 12).alias("predicted_ratio_upper_95"),
        F.round("fair_deposit_lower_95_won", 4).alias("fair_deposit_lower_95_won"), F.round("fair_deposit_upper_95_won", 4).alias("fair_deposit_upper_95_won"),
        F.round("high_price_score", 9).alias("high_price_score"), F.round("low_price_score", 9).alias("low_price_score"),
        F.round("overprice_score", 9).alias("overprice_score"),
    )


# ---------------------------------------------------------------- phase 4-6: encoders, learners, anomaly, valuation
from fairlease.operators import anomaly, models  # noqa: E402
from fairlease.plans import frozen, valuation  # noqa: E402

_EMB_DIM = 64


def _embeddings(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _label_centers(emb: DataFrame) -> list:
    """Per-label mean vectors (k x d numbers to the driver), indexed by label value."""
    rows = emb.groupBy("label").agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(_EMB_DIM)]).collect()
    k = max(r["label"] for r in rows) + 1
    centers = [[0.0] * _EMB_DIM for _ in range(k)]
    for r in rows:
        centers[r["label"]] = [r[f"m{i}"] for i in range(_EMB_DIM)]
    return centers


_EMB_CTE = f"""
with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
u as (select label, i, avg(v[i]) m from e, range(1, {_EMB_DIM + 1}) t(i) group by label, i),
c as (select label, list(m order by i) cen from u group by label),
d as (select vec_id, label, sqrt(list_sum(list_transform(range(1, {_EMB_DIM + 1}), lambda i: (e.v[i] - c.cen[i]) ^ 2))) dist
      from e join c using (label))
"""


@register("centroid_distance", _EMB_CTE + "select vec_id, label, round(dist, 6) kmeans_distance from d")
def centroid_distance_query(spark, sf):
    emb = _embeddings(spark, sf)
    out = anomaly.centroid_distance(emb, _label_centers(emb), "v", "label")
    return out.select("vec_id", "label", F.round("kmeans_distance", 6).alias("kmeans_distance"))


@register(
    "robust_z",
    _EMB_CTE + """
, g as (select median(dist) gmed from d),
gm as (select greatest(median(abs(dist - gmed)), 0.001) gmad, any_value(gmed) gmed from d, g),
cm as (select label, median(dist) cmed, count(*) n from d group by label),
cmad as (select d.label, median(abs(d.dist - cm.cmed)) cmad from d join cm using (label) group by d.label),
st as (select cm.label, case when n < 30 or cmad < 0.001 then gmed else cmed end m, case when n < 30 or cmad < 0.001 then gmad else cmad end s
       from cm join cmad using (label), gm)
select vec_id, d.label, round((dist - m) / (1.4826 * s + 1e-9), 6) kmeans_robust_z from d join st using (label)
""",
)
def robust_z_query(spark, sf):
    emb = _embeddings(spark, sf)
    d = anomaly.centroid_distance(emb, _label_centers(emb), "v", "label")
    rows, _ = anomaly.robust_z(d, "label", "kmeans_distance")
    return rows.select("vec_id", "label", F.round("kmeans_robust_z", 6).alias("kmeans_robust_z"))


@register(
    "merge_small_clusters",
    _EMB_CTE + """
, cnt as (select label, count(*) n from e group by label),
large as (select label from cnt where n >= 55),
pairs as (select s.label raw_cluster, l.label merged, sqrt(list_sum(list_transform(range(1, 65), lambda i: (s.cen[i] - c2.cen[i]) ^ 2))) dd
          from c s join c c2 on true join large l on l.label = c2.label),
pick as (select raw_cluster, case when raw_cluster in (select label from large) then raw_cluster
           else arg_min(merged, dd) end merged_cluster from pairs group by raw_cluster),
disp as (select merged_cluster, row_number() over (order by merged_cluster) d from (select distinct merged_cluster from pick))
select p.raw_cluster, p.merged_cluster, cast(d.d as varchar) display_cluster from pick p join disp d using (merged_cluster)
""",
)
def merge_small_clusters_query(spark, sf):
    """Labels below 55 rows join the nearest large label centroid; display ids 1..n."""
    emb = _embeddings(spark, sf)
    return anomaly.merge_small_clusters(emb.withColumnRenamed("label", "cluster"), _label_centers(emb), "cluster", 55)


@register(
    "cluster_profile",
    with_flagged(
        """
, base as (select housing_type cluster_id, count(*) "rows", round(avg(area_m2_clean), 6) mean_area_m2,
           median(rent_deposit_median) median_rent_deposit, median(area_m2_clean) median_area_m2 from flagged group by 1),
rg as (select housing_type cluster_id, gu_name v, count(*) n from flagged group by 1, 2),
rg3 as (select cluster_id, string_agg(v || ':' || n, ',' order by r) top_regions from (
        select *, row_number() over (partition by cluster_id order by n desc, v asc nulls last) r from rg) where r <= 3 group by 1),
tp as (select housing_type cluster_id, property_type v, count(*) n from flagged group by 1, 2),
tp3 as (select cluster_id, string_agg(v || ':' || n, ',' order by r) top_types from (
        select *, row_number() over (partition by cluster_id order by n desc, v asc nulls last) r from tp) where r <= 3 group by 1)
select * from base join rg3 using (cluster_id) join tp3 using (cluster_id)
"""
    ),
)
def cluster_profile_query(spark, sf):
    fl = flagged_query(spark, sf).withColumn("cluster_id", F.col("housing_type"))
    p = anomaly.cluster_profile(fl, "cluster_id")
    fmt = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["value"], F.lit(":"), s["n"].cast("string"))), ",")
    return p.select(
        "cluster_id", "rows", F.round("mean_area_m2", 6).alias("mean_area_m2"), "median_rent_deposit", "median_area_m2",
        fmt(F.col("top_regions")).alias("top_regions"), fmt(F.col("top_types")).alias("top_types"),
    )


def _unsup_matrix(spark, sf) -> DataFrame:
    def build():
        tr = quality.train_domain(flagged_query(spark, sf))
        u = anomaly.unsupervised_frame(tr)
        cols = [*anomaly.UNSUP_CAT, *anomaly.UNSUP_NUM]
        frame = models.categorical_frame(u, cols, anomaly.UNSUP_CAT, anomaly.UNSUP_NUM, keep=["row_key"])
        return models.design_pipeline(anomaly.UNSUP_CAT, anomaly.UNSUP_NUM).fit(frame).transform(frame).select("row_key", "features")

    return _shared("unsup_matrix", spark, sf, build)


_DESIGN_SQL = with_flagged(
    """
, u as (select row_key, coalesce(property_type, '__MISSING__') property_type, area_m2_clean a, room_count_clean r,
    case when rent_deposit_median is not null then ln(1 + greatest(rent_deposit_median, 0)) end m from train_domain),
med as (select median(a) a, median(r) r, median(m) m from u),
f as (select row_key, property_type, coalesce(u.a, med.a) a, coalesce(u.r, med.r) r, coalesce(u.m, med.m) m from u, med),
st as (select avg(a) aa, stddev_pop(a) sa, avg(r) ar, stddev_pop(r) sr, avg(m) am, stddev_pop(m) sm from f)
select row_key, round((a - aa) / sa, 6) area_scaled, round((r - ar) / sr, 6) rooms_scaled, round((m - am) / sm, 6) median_scaled,
  cast((select count(distinct property_type) from u) + 5 as int) n_features, 1.0::double n_hot
from f, st
"""
)


@register("design_matrix", _DESIGN_SQL)
def design_matrix_query(spark, sf):
    """H1: exact median fill, standardised numerics and one-hot design vectors for the train-domain rows."""
    from pyspark.ml.functions import vector_to_array

    x = _unsup_matrix(spark, sf).select("row_key", vector_to_array("features").alias("v"))
    scaled = {c: F.round(F.col("v")[i], 6) + 0.0 for i, c in enumerate(("area_scaled", "rooms_scaled", "median_scaled"))}
    hot = F.aggregate(F.slice("v", 4, F.size("v")), F.lit(0.0), lambda a, b: a + b)
    return x.select("row_key", *[e.alias(c) for c, e in scaled.items()], F.size("v").alias("n_features"), hot.alias("n_hot"))


def _unsup_train(spark, sf) -> DataFrame:
    """The design matrix's training-split rows: what the unsupervised methods are fitted on."""
    return _unsup_matrix(spark, sf).join(_model_rows(spark, sf).filter("split = 'train'").select("row_key"), "row_key", "left_semi")


def _clusters(spark, sf):
    key = ("kmeans", id(spark), sf)
    hit = _SHARED.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, anomaly.fit_kmeans(_unsup_train(spark, sf), 12))
        _SHARED[key] = hit
    return hit[1]


@register("kmeans_fit", None)
def kmeans_fit_query(spark, sf):
    """J1 (rows-only): best k-means (k=12, all restarts) of the training split; rows per cluster of the whole matrix."""
    km = _clusters(spark, sf)
    return km.transform(_unsup_matrix(spark, sf)).groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))


@register("isolation_forest", None)
def isolation_forest_query(spark, sf):
    """J5 (rows-only): isolation forest of the training split, contamination offset; one score per row."""
    x = _unsup_matrix(spark, sf)
    forest = anomaly.fit_isolation_forest(_unsup_train(spark, sf), "features", "row_key")
    return forest.score_frame(x, "features").select("row_key", "isolation_score")


@register("reconstruction_error", None)
def reconstruction_error_query(spark, sf):
    """J7 (rows-only): PCA(k=3) reconstruction error of the standardised design rows, axes of the training split."""
    out, _ = anomaly.reconstruction_error(_unsup_matrix(spark, sf), "features", 3, fit_on=_unsup_train(spark, sf))
    return out.select("row_key", "reconstruction_error")


@register("pca_2d", None)
def pca_2d_query(spark, sf):
    out, _ = anomaly.pca_2d(_unsup_matrix(spark, sf), "features", _unsup_train(spark, sf))
    return out.select("row_key", "pca_x", "pca_y")


@register("idw_projection", None)
def idw_projection_query(spark, sf):
    """J9 (rows-only): 12-nearest IDW position from a seeded per-cluster plot sample (≤ 350 per cluster)."""
    from fairlease.operators.splits import sample_per_group

    x = _unsup_matrix(spark, sf)
    pc, _ = anomaly.pca_2d(_unsup_train(spark, sf), "features")
    km = _clusters(spark, sf)
    sample = sample_per_group(km.transform(pc), "cluster", 350).select("features", F.col("pca_x").alias("cluster_x"), F.col("pca_y").alias("cluster_y"))
    rows = sample.collect()  # bounded: ≤ 350 x k points
    import numpy as np

    rx = np.array([r["features"].toArray() for r in rows])
    rxy = np.array([[r["cluster_x"], r["cluster_y"]] for r in rows])
    return risk.plot_coords(x, {"points": (rx, rxy)}).select("row_key", "cluster_x", "cluster_y")


def _model_rows(spark, sf):
    return _shared("model_rows", spark, sf, lambda: splits.group_split(valuation.training_target(flagged_query(spark, sf)))[0])


def _model_inputs(rows):
    """(frame function, categorical, numeric): every feature of the final model, as in ``fit_artifacts``."""
    cat, num = valuation.model_features(rows)
    return lambda d: valuation._model_frame(d, cat=cat, num=num), cat, num


@register("tree_models", None)
def tree_models_query(spark, sf):
    """I2 (rows-only): two GBT configs (early-stopped on valid), a forest and their mean; test-split metrics."""
    rows = _model_rows(spark, sf)
    fr, cat, num = _model_inputs(rows)
    fitted, _ = models.train_tree_models(fr(rows.filter("split = 'train'")), fr(rows.filter("split = 'valid'")), cat, num)
    names = [f"pred_{n}" for n in fitted]
    preds = models.add_mean_ensemble(models.predict(fitted, fr(rows.filter("split = 'test'"))), names)
    return stats.regression_metrics(preds, "target", [*names, models.MEAN_ENSEMBLE] if len(names) > 1 else names)


@register("tune_search", None)
def tune_search_query(spark, sf):
    """I3 (rows-only): seeded random search, validation RMSE of every trial."""
    rows = _model_rows(spark, sf)
    fr, cat, num = _model_inputs(rows)
    _best, trials = models.tune(
        fr(rows.filter("split = 'train'")), fr(rows.filter("split = 'valid'")), cat, num,
        {"maxDepth": ("int", 3, 6), "stepSize": ("log", 0.03, 0.3)},
    )
    return trials


@register(
    "ordered_target_statistics",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + """
, tr as materialized (select row_key, gu_name, property_type, target, md5('42|' || row_key) o from sp where split = 'train'),
m as (select avg(target) a from tr)
select row_key, round((coalesce(sum(target) over g, 0) + a) / (count(target) over g + 1), 9) gu_name__te,
  round((coalesce(sum(target) over t, 0) + a) / (count(target) over t + 1), 9) property_type__te
from tr, m window g as (partition by gu_name order by o rows between unbounded preceding and 1 preceding),
  t as (partition by property_type order by o rows between unbounded preceding and 1 preceding)
"""
    ),
)
def ordered_target_statistics_query(spark, sf):
    """H4: ordered target statistics of the training split, over buckets of the permutation."""
    tr = _split(spark, sf, "train")
    out = models.ordered_target_statistics(tr, ["gu_name", "property_type"], "target", rows_per_bucket=500)
    return _round_cols(out.select("row_key", "gu_name__te", "property_type__te"), ["gu_name__te", "property_type__te"], 9)


def _out_of_fold(spark, sf) -> models.OutOfFold:
    key = ("out_of_fold", id(spark), sf)
    hit = _SHARED.get(key)
    if hit is None or hit[0] is not spark:
        rows = _model_rows(spark, sf).filter("split = 'train'")
        fr, cat, num = _model_inputs(rows)
        hit = (spark, models.out_of_fold(fr(rows), splits.month_folds(rows, 5), cat, num, models.TREE_SPECS))
        _SHARED[key] = hit
    return hit[1]


@register("oof_predictions", None)
def oof_predictions_query(spark, sf):
    """I4 (rows-only): 5 contiguous month folds, every tree model, out-of-fold predictions of the complete models."""
    return _out_of_fold(spark, sf).complete().select("row_key", "fold", "model", "oof")


@register("fold_metrics", None)
def fold_metrics_query(spark, sf):
    """I4 (rows-only): metrics, or the error, of every (fold, model)."""
    return _out_of_fold(spark, sf).fold_metrics()


@register(
    "ordinal_encoding",
    with_flagged(
        """
, pm as (select v, dense_rank() over (order by v) + 1 code from (select distinct property_type v from flagged where property_type is not null)),
gm as (select v, dense_rank() over (order by v) + 1 code from (select distinct gu_name v from flagged where gu_name is not null)),
med as (select median(area_m2_clean) m from flagged),
fillv as (select coalesce(area_m2_clean, m) x from flagged, med),
ms as (select avg(x) a, case when stddev_pop(x) = 0 then 1.0 else stddev_pop(x) end sd from fillv)
select f.row_key, case when f.property_type is null then 1 else coalesce(pm.code, 0) end property_type_code,
       case when f.gu_name is null then 1 else coalesce(gm.code, 0) end gu_name_code,
       round((coalesce(f.area_m2_clean, med.m) - ms.a) / ms.sd, 9) area_m2_clean_scaled
from flagged f cross join med cross join ms left join pm on f.property_type = pm.v left join gm on f.gu_name = gm.v
"""
    ),
)
def ordinal_encoding_query(spark, sf):
    """H3: ordinal codes (UNKNOWN 0, MISSING 1, sorted values from 2) and median-filled, standardised numerics."""
    fl = flagged_query(spark, sf)
    maps, st = models.fit_ordinal(fl, ["property_type", "gu_name"], ["area_m2_clean"])
    out = models.apply_ordinal(fl, maps, st, ["property_type", "gu_name"], ["area_m2_clean"])
    return out.select("row_key", F.col("property_type_code").cast("bigint").alias("property_type_code"),
                      F.col("gu_name_code").cast("bigint").alias("gu_name_code"), F.round("area_m2_clean_scaled", 9).alias("area_m2_clean_scaled"))


def _artifacts(spark, sf):
    key = ("artifacts", id(spark), sf)
    hit = _SHARED.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, valuation.fit_artifacts(_model_rows(spark, sf)))
        _SHARED[key] = hit
    return hit[1]


@register("value_listings", None)
def value_listings_query(spark, sf):
    """K9 (rows-only): every flagged listing valued against the fitted artefacts."""
    fl = flagged_query(spark, sf)
    return valuation.value_listings(fl, _artifacts(spark, sf)).select(*valuation.VALUATION_COLUMNS)


# ---------------------------------------------------------------- remaining sources / cleaning composites
_SALES_SQL = with_binding(
    "select row_key, gu_code, gu_name, ym, contract_date, property_type, round(sale_price_won, 2) sale_price_won, area_m2,"
    " round(sale_price_per_m2, 4) sale_price_per_m2 from sales where ym between '1996-01' and '1999-12'"
)


@register("clean_sales", _SALES_SQL)
def clean_sales_query(spark, sf):
    """B15 + B8: raw all-string sale extract (API tag names) -> typed sales of a period."""
    s = _sources(spark, sf)[2]
    raw = s.select(
        F.col("gu_code").alias("sggCd"), F.year("contract_date").cast("string").alias("dealYear"),
        F.month("contract_date").cast("string").alias("dealMonth"), F.dayofmonth("contract_date").cast("string").alias("dealDay"),
        F.format_number(F.col("sale_price_won") / 10000, 4).alias("dealAmount"), F.col("area_m2").cast("string").alias("buildingAr"),
        "property_type", "row_key",
    )
    out = clean.clean_sales(raw, _regions(spark, sf), "1996-01", "1999-12")
    return out.select("row_key", "gu_code", "gu_name", "ym", "contract_date", "property_type", F.round("sale_price_won", 2).alias("sale_price_won"),
                      "area_m2", F.round("sale_price_per_m2", 4).alias("sale_price_per_m2"))


_LISTING_SQL = with_binding(
    "select row_key, gu_code, gu_name, ym, contract_date, housing_type, room_count, area_m2, household_size, deposit_won, support_won,"
    " round(support_ratio, 9) support_ratio from listings"
)


@register("clean_listings", _LISTING_SQL)
def clean_listings_query(spark, sf):
    """Raw listing file columns (address, date text, numbers as text) -> typed listings."""
    lst = _sources(spark, sf)[0]
    n = clean.LISTING_COLUMNS
    raw = lst.select(
        F.concat(F.lit("서울특별시 "), F.col("gu_name"), F.lit(" 1-1")).alias(n["address"]),
        F.date_format("contract_date", "yyyy-MM-dd").alias(n["contract_date"]), F.col("housing_type").alias(n["housing_type"]),
        F.col("detail_type").alias(n["detail_type"]), F.col("room_count").cast("string").alias(n["room_count"]),
        F.col("area_m2").cast("string").alias(n["area"]), F.col("household_size").cast("string").alias(n["household_size"]),
        F.format_number("deposit_won", 2).alias(n["deposit"]), F.col("support_won").cast("string").alias(n["support"]),
        F.col("monthly_rent_won").cast("string").alias(n["monthly_rent"]), "row_key",
    )
    out = clean.clean_listings(raw, _regions(spark, sf), pattern=r"서울특별시\s+(NATION_[0-9]+)")
    return out.select("row_key", "gu_code", "gu_name", "ym", "contract_date", "housing_type", "room_count", "area_m2", "household_size",
                      "deposit_won", "support_won", F.round("support_ratio", 9).alias("support_ratio"))


@register(
    "region_dim",
    "select distinct substr(code, 1, 5) gu_code, gu gu_name from (select lpad(cast(n_nationkey as varchar), 5, '0') || '00000' code,"
    " n_name gu, case when n_regionkey < 3 then '서울특별시' else '부산광역시' end sido,"
    " case when n_regionkey = 2 then '2020-01-01' end deleted from nation) where sido = '서울특별시' and deleted is null",
)
def region_dim_query(spark, sf):
    """Active districts of one province from a legal-area code table (derived from nation)."""
    codes = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.concat(F.lpad(F.col("n_nationkey").cast("string"), 5, "0"), F.lit("00000")).alias("법정동코드"),
        F.when(F.col("n_regionkey") < 3, "서울특별시").otherwise("부산광역시").alias("시도명"),
        F.col("n_name").alias("시군구명"),
        F.when(F.col("n_regionkey") == 2, F.lit("2020-01-01")).alias("삭제일자"),
    )
    return clean.region_dim(codes)


@register("read_listings_jsonl", _LISTING_SQL.replace("round(support_ratio, 9) support_ratio", "round(support_ratio, 9) support_ratio"))
def read_listings_jsonl(spark, sf):
    """A8 + A9: listings written as JSON lines to the shared folder and read back with a schema."""
    lst = _sources(spark, sf)[0]
    path = io.shared_path(spark, "listings", uuid.uuid4().hex + ".jsonl")
    io.write_table(lst, path, fmt="json")
    back = io.read_listings(spark, path, lst.schema)
    return back.select("row_key", "gu_code", "gu_name", "ym", "contract_date", "housing_type", "room_count", "area_m2", "household_size",
                       "deposit_won", "support_won", F.round("support_ratio", 9).alias("support_ratio"))


@register("read_or_empty", _LEASE_CHECK_SQL)
def read_or_empty_query(spark, sf):
    """A3: an existing table plus a missing one (empty frame with the declared schema)."""
    les = _sources(spark, sf)[1]
    base = io.shared_path(spark, "tables", uuid.uuid4().hex)
    io.write_table(les, f"{base}/leases", partition_by=("ym",))
    got = io.read_or_empty(spark, f"{base}/leases", les.select(*[c for c in les.columns if c != "ym"], "ym").schema)
    missing = io.read_or_empty(spark, f"{base}/absent", got.schema)
    return _lease_check(got.unionByName(missing))


@register("write_report", _REPORT_SQL)
def write_report_query(spark, sf):
    """A10: the preprocessing report written as JSON and read back."""
    fl = flagged_query(spark, sf)
    _, train, ood_df = quality.partition_quality(fl)
    report = quality.quality_report(_sources(spark, sf)[0], fl, train, ood_df)
    path = io.shared_path(spark, "reports", uuid.uuid4().hex)
    io.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


#: C8 by hand: what the final model may see of the preprocessed table, with the rows that have a value.
_FEATURE_LIST = {
    "categorical": "gu_code gu_name ym property_type housing_type detail_type gu_property gu_ym property_ym housing_type_ym detail_type_ym",
    "numeric": "room_count area_m2 household_size rent_txn_count jeonse_txn_count rent_deposit_median rent_deposit_mean rent_deposit_per_m2_median"
    " rent_deposit_per_m2_mean monthly_rent_median area_m2_median sale_txn_count sale_price_median sale_price_mean sale_price_per_m2_median"
    " sale_price_per_m2_mean sale_area_m2_median is_ood_property_type is_in_domain_property_type is_exact_duplicate area_missing_or_zero area_too_small"
    " area_review_large area_too_large room_missing room_too_large household_size_missing_or_zero sale_feature_missing sale_low_confidence"
    " rent_feature_missing area_m2_clean room_count_clean household_size_clean room_count_imputed household_size_imputed",
}
_COMBO_SOURCES = {"gu_property": ("gu_name", "property_type"), "gu_ym": ("gu_name", "ym"), "property_ym": ("property_type", "ym"), "housing_type_ym": ("housing_type", "ym"), "detail_type_ym": ("detail_type", "ym")}
_FEATURES_SQL = with_flagged(
    " " + " union all ".join(
        f"select '{f}' feature, '{kind}' kind, count({'*' if f in _COMBO_SOURCES else f}) non_null from flagged" for kind, names in _FEATURE_LIST.items() for f in names.split()
    )
)


@register("select_features", _FEATURES_SQL)
def select_features_query(spark, sf):
    """Leakage-safe feature lists of the final model and how many rows have each."""
    fl = add_combo(flagged_query(spark, sf))
    feats, cat, _num = quality.final_features(fl)
    counts = fl.agg(*[F.count(F.col(f)).alias(f) for f in feats])
    entry = [F.struct(F.lit(f).alias("feature"), F.lit("categorical" if f in cat else "numeric").alias("kind"), F.col(f).alias("non_null")) for f in feats]
    return counts.select(F.explode(F.array(*entry)).alias("e")).select("e.*")


# ---------------------------------------------------------------- remaining model-side operators
@register(
    "prediction_output",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + "select gu_code, gu_name, ym, property_type, deposit_won, rent_deposit_median, target,"
        " pred_a, round(target - pred_a, 12) residual_a, pred_b, round(target - pred_b, 12) residual_b from sp where split = 'test'"
    ),
)
def prediction_output_query(spark, sf):
    """Context columns + target + pred_<model> + residual_<model>."""
    t = _split(spark, sf, "test")
    out = ensemble.prediction_output(t, ["gu_code", "gu_name", "ym", "property_type", "deposit_won", "rent_deposit_median"], "target",
                                     {"a": F.col("pred_a"), "b": F.col("pred_b")})
    return out.withColumns({"residual_a": F.round("residual_a", 12), "residual_b": F.round("residual_b", 12)})


@register(
    "categorical_frame",
    with_flagged(
        "select row_key, coalesce(cast(gu_name as varchar), '__MISSING__') gu_name, coalesce(cast(detail_type as varchar), '__MISSING__') detail_type,"
        " cast(null as varchar) absent_cat, area_m2_clean, room_count_clean, cast(null as double) absent_num from flagged"
    ),
)
def categorical_frame_query(spark, sf):
    """H2: categoricals as strings with __MISSING__, numerics as double, absent features as NULL."""
    fl = flagged_query(spark, sf)
    out = models.categorical_frame(fl, ["gu_name", "detail_type", "absent_cat", "area_m2_clean", "room_count_clean", "absent_num"],
                                   ["gu_name", "detail_type", "absent_cat"], ["area_m2_clean", "room_count_clean", "absent_num"], keep=["row_key"])
    return out.withColumn("absent_cat", F.when(F.col("absent_cat") != "__MISSING__", F.col("absent_cat")))


@register(
    "target_encoding",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + """
, tr as (select row_key, ym, gu_name || '__' || ym gu_ym, property_type || '__' || ym property_ym, target from sp where split = 'train'),
fo as (select ym, ntile(5) over (order by ym) - 1 fold from (select distinct ym from tr)),
r as (select tr.*, fold from tr join fo using (ym)),
f as (select fold, sum(target) s, count(target) n from r group by 1),
pr as (select fold, ((select sum(s) from f) - s) / ((select sum(n) from f) - n) prior from f),
ga as (select gu_ym v, fold, sum(target) s, count(target) n from r group by 1, 2), gt as (select v, sum(s) s, sum(n) n from ga group by 1),
pa as (select property_ym v, fold, sum(target) s, count(target) n from r group by 1, 2), pt as (select v, sum(s) s, sum(n) n from pa group by 1)
select r.row_key, r.fold, round((gt.s - ga.s + 20 * prior) / (gt.n - ga.n + 20), 9) gu_ym__te, round((pt.s - pa.s + 20 * prior) / (pt.n - pa.n + 20), 9) property_ym__te
from r join pr using (fold) join ga on ga.v = r.gu_ym and ga.fold = r.fold join gt on gt.v = r.gu_ym
  join pa on pa.v = r.property_ym and pa.fold = r.fold join pt on pt.v = r.property_ym
"""
    ),
)
def target_encoding_query(spark, sf):
    """H4: out-of-fold target codes of two combined keys over the training rows' five month folds."""
    rows = add_combo(_split(spark, sf, "train"))
    out = models.out_of_fold_encoding(rows, ["gu_ym", "property_ym"], "target", splits.month_folds(rows, 5))
    return out.select("row_key", "fold", *[F.round(c, 9).alias(c) for c in ("gu_ym__te", "property_ym__te")])


def add_combo(df):
    from fairlease.functions.columns import add_combo_features

    return add_combo_features(df)


@register("holdout_predictions", None)
def holdout_predictions_query(spark, sf):
    """I5 (rows-only): fit once on train, predict the validation rows with context columns."""
    rows = _model_rows(spark, sf)
    fr, cat, num = _model_inputs(rows)
    return models.holdout_predictions(fr(rows.filter("split = 'train'")), fr(rows.filter("split = 'valid'")), cat, num, models.TREE_SPECS, context=["gu_name", "property_type", "ym"])


@register("final_model_roundtrip", None)
def final_model_roundtrip_query(spark, sf):
    """I11 (rows-only): fit the final model, save model + metadata to the shared folder, load, score test."""
    rows = _model_rows(spark, sf)
    fr, cat, num = _model_inputs(rows)
    m = models.fit_model(fr(rows.filter("split = 'train'")), fr(rows.filter("split = 'valid'")), cat, num, valuation.FINAL_SPEC)
    path = io.shared_path(spark, "models", uuid.uuid4().hex)
    models.save_model(m, path, {"features": cat + num, "confidence_level": 0.95})
    loaded, meta = models.load_model(path)
    return loaded.transform(fr(rows.filter("split = 'test'"))).select("row_key", "target", F.col("prediction").alias("pred_final"))


@register("best_run_published", None)
def best_run_published_query(spark, sf):
    """I11 (rows-only): two forests scored on the test split, the better one of the scoreboard fitted with everything
    that scoring needs, published, and the newest complete version used to value the test split."""
    rows = _model_rows(spark, sf)
    fr, cat, num = _model_inputs(rows)
    specs = {"shallow": {"kind": "rf", "maxDepth": 4, "numTrees": 20}, "deep": {"kind": "rf", "maxDepth": 8, "numTrees": 20}}
    fitted, _ = models.train_tree_models(fr(rows.filter("split = 'train'")), fr(rows.filter("split = 'valid'")), cat, num, specs)
    test = fr(rows.filter("split = 'test'"))
    m = stats.regression_metrics(models.predict(fitted, test), "target", [f"pred_{n}" for n in fitted])
    new = m.select(F.lit("forests").alias("experiment"), F.expr("substr(model, 6)").alias("model"), F.lit("test").alias("split"), "rmse", "mae", "r2", F.lit("target").alias("target"), F.col("n").alias("rows"))
    scores = splits.upsert_scores(None, new)
    root = io.shared_path(spark, "published", uuid.uuid4().hex)
    valuation.fit_best(rows, scores, valuation.spec_registry(spark, specs), root, "forests")
    art = valuation.load_newest(spark, root)
    out = valuation.value_listings(rows.filter("split = 'test'").drop("target", "split"), art)
    return out.select(F.lit(art.metadata["model"]).alias("model"), "row_key", "predicted_log_ratio", "risk_label", "anomaly_grade")


@register("lof_scores", None)
def lof_scores_query(spark, sf):
    """J6 (exact kNN, rows-only): LOF novelty scores (35 neighbours) of every train-domain row against
    the training-split rows of the unsupervised design matrix."""
    from fairlease.operators import lof

    x = _unsup_matrix(spark, sf)
    return lof.lof_scores(_unsup_train(spark, sf), x, "features", "row_key", k=35, contamination=0.02).select("row_key", "lof_score")


# ---------------------------------------------------------------- requests, stored artefacts, feature attachment
@register(
    "normalize_listing_input",
    with_binding(
        ", names(i, gu, code) as (values "
        + ", ".join(f"({i}, '{g}', '{c}')" for i, (g, c) in enumerate(C.GU_CODES.items()))
        + "), labels(t, label) as (values "
        + ", ".join(f"('{t}', '{label}')" for label, t in C.PROPERTY_LABELS.items())
        + """)
select l.row_key, case when try_cast(l.gu_code as int) % 7 = 0 then '강남구' when try_cast(l.gu_code as int) % 7 = 1 then '모름구' else n.gu end gu_name,
  case when try_cast(l.gu_code as int) % 7 = 0 then '11680' when try_cast(l.gu_code as int) % 7 = 1 then '' else n.code end gu_code,
  l.ym, case when l.room_count is null then 'apt' else l.property_type end property_type,
  case when l.room_count is null then '아파트' else b.label end housing_type, case when l.room_count is null then '아파트' else b.label end detail_type,
  round(l.area_m2, 2) area_m2_clean, coalesce(l.room_count, 3.0) room_count_clean, 2.0::double household_size_clean,
  case when l.household_size is not null then round(l.deposit_won, 0) end deposit_won
from listings l join names n on n.i = try_cast(l.gu_code as int) join labels b on b.t = l.property_type
"""
    ),
)
def normalize_listing_input_query(spark, sf):
    """Listing requests as people type them (names, labels, separators, blanks) to valuation columns."""
    lst = _sources(spark, sf)[0]
    i = F.col("gu_code").cast("int")
    gu = F.when(i % 7 == 0, F.lit(None)).when(i % 7 == 1, F.lit("모름구")).otherwise(F.get(F.array(*[F.lit(g) for g in C.GU_CODES]), i))
    label = F.create_map(*[F.lit(x) for label, t in C.PROPERTY_LABELS.items() for x in (t, label)])[F.col("property_type")]
    typed = lst.select(
        "row_key", "ym", gu.alias("gu_name"), F.when(F.col("room_count").isNotNull(), label).alias("property_label"),
        F.concat(F.lit(" "), F.format_number("area_m2", 2)).alias("area_m2_clean"), F.coalesce(F.col("room_count").cast("string"), F.lit("  ")).alias("room_count_clean"),
        F.when(F.col("household_size").isNotNull(), F.format_number("deposit_won", 0)).otherwise("").alias("deposit_won"),
    )
    return C.normalize_listing_input(typed, ("row_key",))


@register("saved_valuation", None)
def saved_valuation_query(spark, sf):
    """I11 + K9: artefacts saved to the shared folder, loaded again, and every listing valued from the folder alone."""
    path = valuation.save_artifacts(_artifacts(spark, sf), io.shared_path(spark, "artifacts", uuid.uuid4().hex))
    return valuation.value_listings(flagged_query(spark, sf), valuation.load_artifacts(spark, path)).select(*valuation.VALUATION_COLUMNS)


_FROZEN_SQL = with_flagged(
    _PREDS_CTE + _SPLIT_CTE
    + frozen.valuation_sql(_MEDIAN_LEVELS_SQL, _MEDIAN_JOINS_SQL, _MEDIAN_VALUE_SQL, _MEDIAN_SOURCE_SQL, C.GRADE_BANDS, C.RISK_BANDS_SCORING)
)
_VALUED_DIGITS = {
    "predicted_log_ratio": 9, "interval_q": 9, "predicted_fair_deposit_won": 0, "fair_deposit_lower_95_won": 0, "fair_deposit_upper_95_won": 0,
    "kmeans_distance": 9, "isolation_score": 9, "anomaly_percentile": 6, "overprice_score": 6,
}


def _valued(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, _VALUED_DIGITS[c]) + 0.0).alias(c) if c in _VALUED_DIGITS else F.col(c) for c in valuation.VALUATION_COLUMNS])


def _frozen_root(spark, sf) -> str:
    """A root folder with one published version of the frozen artefacts."""
    root = io.shared_path(spark, "published", uuid.uuid4().hex)
    valuation.publish_artifacts(frozen.frozen_artifacts(flagged_query(spark, sf), _model_rows(spark, sf)), root)
    return root


@register("frozen_valuation", _FROZEN_SQL)
def frozen_valuation_query(spark, sf):
    """Every listing valued with published artefacts whose fitted numbers are given, so that SQL can follow."""
    return _valued(valuation.value_listings(flagged_query(spark, sf), valuation.load_newest(spark, _frozen_root(spark, sf))))


#: Listings whose line is cut off on the way into the stream.
_CUT_LINES = "length(row_key) % 7 = 0"
_BATCHES, _LEAST_FILES, _LINES_PER_FILE = 3, 24, 200_000


@register(
    "valuation_stream",
    f"select *, false dead_letter from ({_FROZEN_SQL}) where not ({_CUT_LINES}) union all select row_key, "
    + ", ".join(f"null {c}" for c in ("rent_deposit_median", "rent_deposit_median_source", "predicted_log_ratio", "interval_q", "interval_source", "predicted_fair_deposit_won", "fair_deposit_lower_95_won", "fair_deposit_upper_95_won", "cluster_id", "kmeans_distance", "isolation_score", "anomaly_percentile", "overprice_score", "model_scope_status", "risk_label", "price_risk_grade", "anomaly_grade"))
    + f", true from ({with_binding('select row_key from listings')}) where {_CUT_LINES}",
)
def valuation_stream_query(spark, sf):
    """Every listing as a line of JSON, valued by the stream in micro-batches; cut lines end as dead letters."""
    from fairlease.streaming.valuation_stream import value_stream

    fl = flagged_query(spark, sf)
    fl = fl.select("row_key", *[c for c in fl.columns if c != "row_key"])
    line = F.to_json(F.struct("*"))
    cut = F.expr(_CUT_LINES)
    base = io.shared_path(spark, "stream", uuid.uuid4().hex)
    lines = fl.withColumn("line", line).select(F.when(cut, F.expr("substr(line, 1, length(line) div 2)")).otherwise(F.col("line")).alias("value"))
    # written where they are made, compressed (a line names every column), in files that a batch reads side by side
    rows = _shared("listings", spark, sf, lambda: binding.listings(spark, sf)).count()
    most = max(1, min(_LINES_PER_FILE, -(-rows // _LEAST_FILES)))
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{base}/in")
    files = len(spark.read.text(f"{base}/in").inputFiles())
    query = value_stream(
        spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", _frozen_root(spark, sf), fl.schema, fmt="text", max_files_per_trigger=max(1, -(-files // _BATCHES)),
        dead_letters=f"{base}/dead",
    )
    query.awaitTermination()
    out = _valued(spark.read.parquet(f"{base}/out")).withColumn("dead_letter", F.lit(False))
    dead = spark.read.parquet(f"{base}/dead").select(F.regexp_extract("line", '"row_key":"([^"]*)"', 1).alias("row_key"), F.lit(True).alias("dead_letter"))
    return out.unionByName(dead, allowMissingColumns=True)


@register("unsupervised_features", None)
def unsupervised_features_query(spark, sf):
    """J11 (rows-only): the four methods' scores for every train-domain row, fitted on the training split."""
    rows = splits.group_split(valuation.training_target(flagged_query(spark, sf)))[0]
    out = anomaly.unsupervised_features(rows, F.col("split") == "train")
    return out.select("row_key", "split", "cluster_id", "kmeans_distance", "kmeans_robust_z", "isolation_score", "lof_score", "autoencoder_error")


@register(
    "unsupervised_frame",
    with_flagged("select row_key, property_type, area_m2_clean, room_count_clean, round(ln(1 + case when rent_deposit_median is not null then greatest(rent_deposit_median, 0) end), 9) rent_deposit_median_log from flagged"),
)
def unsupervised_frame_query(spark, sf):
    """The unsupervised matrix's columns."""
    out = anomaly.unsupervised_frame(flagged_query(spark, sf))
    return out.select("row_key", *anomaly.UNSUP_CAT, "area_m2_clean", "room_count_clean", F.round("rent_deposit_median_log", 9).alias("rent_deposit_median_log"))


@register("plot_coords", with_flagged("select row_key, area_m2_clean cluster_x, rent_deposit_median / 100000000.0 cluster_y from flagged"))
def plot_coords_query(spark, sf):
    """K8: plot position from area and lease median."""
    return risk.plot_coords(flagged_query(spark, sf)).select("row_key", "cluster_x", "cluster_y")


@register(
    "join_index",
    with_binding(", idx as (select gu_code, ym, avg(deposit_won) price_index from leases group by all) select l.row_key, round(i.price_index, 4) price_index from listings l left join idx i on i.gu_code = l.gu_code and i.ym = l.ym"),
)
def join_index_query(spark, sf):
    """D3: a (region, month) index table joined onto the listings."""
    lst, les, _ = _sources(spark, sf)
    index = les.groupBy("gu_code", "ym").agg(F.avg("deposit_won").alias("price_index"))
    return market.join_index(lst, index).select("row_key", F.round("price_index", 4).alias("price_index"))


def _write_cp949(df: DataFrame, path: str, *by: str) -> None:
    """Test files in a legacy charset, which Spark writes under a setting of its own."""
    name = "spark.sql.legacy.javaCharsets"
    before = df.sparkSession.conf.get(name)
    df.sparkSession.conf.set(name, "true")
    try:
        df.write.partitionBy(*by).option("header", True).option("encoding", "cp949").option("maxRecordsPerFile", io.CSV_FILE_ROWS).csv(path)
    finally:
        df.sparkSession.conf.set(name, before)


@register(
    "csv_mixed_charsets",
    with_binding(
        "select row_key, '서울 ' || gu_name address, case when property_type in ('apt', 'officetel') then null else round(area_m2, 4) end area,"
        " case when property_type in ('apt', 'officetel') then ym end ym from leases"
    ),
)
def csv_mixed_charsets(spark, sf):
    """A2: hundreds of small files, two headers and two charsets by turns, read in one scan and aligned by name."""
    les = _sources(spark, sf)[1].select("*", F.concat(F.lit("서울 "), F.col("gu_name")).alias("address"), F.concat("gu_code", F.lit("-"), F.substring("ym", 1, 4)).alias("file"))
    base = io.shared_path(spark, "index", uuid.uuid4().hex)
    apt_like = F.coalesce(F.col("property_type").isin("apt", "officetel"), F.lit(False))
    legacy = F.substring("ym", 4, 1).cast("int") % 2 == 1
    for name, rows, cols in (("a", apt_like, ("row_key", "address", "ym")), ("b", ~apt_like, ("area", "row_key", "address"))):
        part = les.where(rows).withColumn("area", F.round("area_m2", 4))
        part.where(~legacy).select("file", *cols).write.partitionBy("file").option("header", True).csv(f"{base}/{name}-utf8")
        _write_cp949(part.where(legacy).select("file", *cols), f"{base}/{name}-cp949", "file")
    out = io.read_csv_files(spark, f"{base}/*/file=*/*.csv")
    return out.select("row_key", "address", F.col("area").cast("double").alias("area"), "ym")


@register("read_table_legacy_charset", with_binding("select row_key, '서울 ' || gu_name address, ym from listings"))
def read_table_legacy_charset(spark, sf):
    """A1: a CSV in a legacy Korean charset, read with a declared schema."""
    lst = _sources(spark, sf)[0].select("row_key", F.concat(F.lit("서울 "), F.col("gu_name")).alias("address"), "ym")
    path = io.shared_path(spark, "legacy", uuid.uuid4().hex + ".csv")
    _write_cp949(lst, path)
    return io.read_table(spark, path, lst.schema, encoding="cp949")


@register(
    "anomaly_score",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + """
, tr as (select pred_a v from sp where split = 'train'), tb as (select area_m2_clean v from sp where split = 'train'),
q as (select quantile_cont(v, 0.85) an, quantile_cont(v, 0.999) ah, count(v) na from tr), qb as (select quantile_cont(v, 0.85) bn, quantile_cont(v, 0.999) bh, count(v) nb from tb),
t as (select row_key, pred_a, area_m2_clean from sp where split = 'test'),
p as (select t.*, (select count(*) from tr where tr.v <= t.pred_a) / na pa, (select count(*) from tb where tb.v <= t.area_m2_clean) / nb pb, an, ah, bn, bh from t, q, qb),
s as (select *, case when ah <= an then 100 * pa else least(greatest((pred_a - an) / (ah - an) * 100, 0), 100) end sa,
  case when bh <= bn then 100 * pb else least(greatest((area_m2_clean - bn) / (bh - bn) * 100, 0), 100) end sb from p)
select row_key, round(100 * pa, 9) kmeans_distance_percentile, round(100 * pb, 9) isolation_score_percentile, round((100 * pa + 100 * pb) / 2, 9) anomaly_raw_percentile,
  round(least(greatest(0.55 * sa + 0.45 * sb, 0), 100), 9) anomaly_percentile from s
"""
    ),
)
def anomaly_score_query(spark, sf):
    """K7: percentiles and tail scores of two score columns (stand-ins from the tables) against the training rows."""
    out = risk.anomaly_score(_split(spark, sf, "test"), _split(spark, sf, "train"), "pred_a", "area_m2_clean")
    cols = ("kmeans_distance_percentile", "isolation_score_percentile", "anomaly_raw_percentile", "anomaly_percentile")
    return out.select("row_key", *[F.round(c, 9).alias(c) for c in cols])


_REPORT_MODELS = {**{p: p for p in _PRED_SQL}, "pred_ensemble_equal": "(pred_a + pred_b + pred_c) / 3", "pred_ensemble_weighted": "0.5 * pred_a + 0.3 * pred_b + 0.2 * pred_c"}


@register(
    "ensemble_report",
    with_flagged(
        _PREDS_CTE + _SPLIT_CTE + ", t as (select * from sp where split = 'test'), "
        + ", ".join(
            f"m{i} as (select '{m}' model, target y, {e} p from t), e{i} as (select model, exp(y) - 1 y, exp(p) - 1 p from m{i})" for i, (m, e) in enumerate(_REPORT_MODELS.items())
        )
        + " "
        + " union all ".join(
            f"select model, '{scale}' scale, count(*) n, round(sqrt(avg((y - p) ^ 2)), 9) rmse, round(avg(abs(y - p)), 9) mae,"
            f" round(1 - sum((y - p) ^ 2) / (var_pop(y) * count(y)), 9) r2 from {table}{i} group by model"
            for i in range(len(_REPORT_MODELS)) for scale, table in (("log", "m"), ("ratio", "e"))
        )
    ),
)
def ensemble_report_query(spark, sf):
    """Metrics of the base and ensemble predictions on the log and the ratio scale."""
    t = ensemble.add_ensembles(_split(spark, sf, "test"), list(_PRED_SQL), {"pred_a": 0.5, "pred_b": 0.3, "pred_c": 0.2})
    return _round_cols(ensemble.ensemble_report(t, list(_PRED_SQL)), ["rmse", "mae", "r2"], 9)
