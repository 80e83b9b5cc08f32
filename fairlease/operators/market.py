"""Market statistics and market joins.

Market cells are keyed (region code, region name, month, property type).
Counts/means are one hash aggregate with map-side partial aggregation; medians
go through :mod:`fairlease.operators.quantiles` so a hot cell cannot pin one task.
Joins to listings are null-safe left joins (pandas ``merge`` matches NaN keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlease.functions.columns import safe_ratio
from fairlease.operators.quantiles import _null_safe_join, group_percentiles

MARKET_KEYS = ["gu_code", "gu_name", "ym", "property_type"]
JOIN_KEYS = ["gu_code", "ym", "property_type"]


def _market(df: DataFrame, keys, counts, means, medians, strategy: str, hot_rows: int | None = None) -> DataFrame:
    aggs = list(counts) + [F.avg(c).alias(o) for o, c in means]
    if strategy == "hash":  # caller vouches that no cell is hot
        aggs += [F.percentile(c, 0.5).alias(o) for o, c in medians]
        return df.groupBy(*keys).agg(*aggs)
    from fairlease.session import materialize

    # one row per cell; its row count doubles as the hot-cell check of the median pass
    base = materialize(df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_gn")))
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    med = group_percentiles(df, keys, [(o, c, 0.5) for o, c in medians], strategy, group_sizes=base.select(*keys, "_gn"), **extra)
    return _null_safe_join(base.drop("_gn"), med, keys)


# E1 ---------------------------------------------------------------------------
def lease_market_features(
    leases: DataFrame, keys: Sequence[str] = MARKET_KEYS, rent_type: str | None = None, strategy: str = "auto",
    hot_rows: int | None = None,
) -> DataFrame:
    """Per market cell: transaction count, jeonse count, deposit / per-m² medians and means, rent and area medians.

    ``rent_type`` optionally restricts to one lease kind (the reference uses all leases).
    """
    if rent_type is not None:
        leases = leases.filter(F.col("rent_type") == rent_type)
    counts = [
        F.count(F.lit(1)).alias("rent_txn_count"),
        F.count_if(F.col("rent_type") == "jeonse").alias("jeonse_txn_count"),
    ]
    means = [("rent_deposit_mean", "deposit_won"), ("rent_deposit_per_m2_mean", "deposit_per_m2")]
    medians = [
        ("rent_deposit_median", "deposit_won"),
        ("rent_deposit_per_m2_median", "deposit_per_m2"),
        ("monthly_rent_median", "monthly_rent_won"),
        ("area_m2_median", "area_m2"),
    ]
    out = _market(leases, list(keys), counts, means, medians, strategy, hot_rows)
    return out.select(
        *keys, "rent_txn_count", "jeonse_txn_count", "rent_deposit_median", "rent_deposit_mean",
        "rent_deposit_per_m2_median", "rent_deposit_per_m2_mean", "monthly_rent_median", "area_m2_median",
    )


# E2 ---------------------------------------------------------------------------
def sale_market_features(sales: DataFrame, keys: Sequence[str] = MARKET_KEYS, strategy: str = "auto") -> DataFrame:
    counts = [F.count(F.lit(1)).alias("sale_txn_count")]
    means = [("sale_price_mean", "sale_price_won"), ("sale_price_per_m2_mean", "sale_price_per_m2")]
    medians = [
        ("sale_price_median", "sale_price_won"),
        ("sale_price_per_m2_median", "sale_price_per_m2"),
        ("sale_area_m2_median", "area_m2"),
    ]
    out = _market(sales, list(keys), counts, means, medians, strategy)
    return out.select(
        *keys, "sale_txn_count", "sale_price_median", "sale_price_mean", "sale_price_per_m2_median",
        "sale_price_per_m2_mean", "sale_area_m2_median",
    )


# D1 ---------------------------------------------------------------------------
def join_region(df: DataFrame, region_dim: DataFrame, key: str = "gu_code") -> DataFrame:
    """Attach region attributes from the (small, fixed-size) region dimension by broadcast."""
    dim = region_dim.select(key, *[c for c in region_dim.columns if c != key and c not in df.columns])
    return df.join(F.broadcast(dim), key, "left")


# D2 ---------------------------------------------------------------------------
def join_market(
    listings: DataFrame, lease_feats: DataFrame | None, sale_feats: DataFrame | None, keys: Sequence[str] = JOIN_KEYS
) -> DataFrame:
    """Null-safe left joins of listings to lease and sale market cells; the cells' region name is dropped."""
    out = listings
    for feats in (lease_feats, sale_feats):
        if feats is None:
            continue
        feats = feats.drop("gu_name") if "gu_name" not in keys else feats
        out = _null_safe_join(out, feats, list(keys))
    return out


# D3 ---------------------------------------------------------------------------
def join_index(df: DataFrame, index: DataFrame | None) -> DataFrame:
    """Optional left join of an index table on whichever of (gu_code, ym) it carries."""
    if index is None:
        return df
    keys = [k for k in ("gu_code", "ym") if k in index.columns]
    if not keys:
        return df
    return _null_safe_join(df, index, keys)


# D4 ---------------------------------------------------------------------------
def add_market_ratios(df: DataFrame) -> DataFrame:
    """Listing deposit vs lease / sale medians, and lease median vs sale median (only when both inputs exist)."""
    cols = {}
    if "rent_deposit_median" in df.columns:
        cols["lh_vs_rent_median_ratio"] = safe_ratio("deposit_won", "rent_deposit_median")
    if "sale_price_median" in df.columns:
        cols["lh_vs_sale_median_ratio"] = safe_ratio("deposit_won", "sale_price_median")
    if {"rent_deposit_median", "sale_price_median"} <= set(df.columns):
        cols["jeonse_to_sale_ratio_median"] = safe_ratio("rent_deposit_median", "sale_price_median")
    return df.withColumns(cols) if cols else df


def modeling_dataset(listings: DataFrame, leases: DataFrame, sales: DataFrame, strategy: str = "auto") -> DataFrame:
    """Listings + lease/sale market features + market ratios (one lazy lineage)."""
    from fairlease.session import materialize

    # a row a cell: stored, their size is known before the join, so small ones need no shuffle of the listings
    cells = [materialize(lease_market_features(leases, strategy=strategy)), materialize(sale_market_features(sales, strategy=strategy))]
    return add_market_ratios(join_market(listings, *cells))
