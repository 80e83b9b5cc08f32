"""Entry point A as one lazy lineage: clean facts -> market features -> market join ->
ratios -> quality flags -> masks / cascading imputation / winsorisation -> domain split.

The flagged table feeds three outputs, a report and several statistics, so it
is the one place worth materialising (``persist``); at cluster scale pass
``checkpoint=True`` to write it to the shared checkpoint folder instead.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from fairlease.operators import market, quality
from fairlease.session import materialize

# Content columns for the exact-duplicate rule (every listing column but the row id).
CONTENT_COLUMNS = (
    "gu_code", "gu_name", "ym", "contract_date", "property_type", "housing_type", "detail_type", "room_count",
    "area_m2", "household_size", "deposit_won", "support_won", "tenant_deposit_won", "monthly_rent_won",
    "deposit_per_m2", "support_ratio",
)


def flagged_dataset(
    listings: DataFrame, leases: DataFrame, sales: DataFrame, dup_cols=CONTENT_COLUMNS, fit_on=None, mode: str = "checkpoint",
    modeling: DataFrame | None = None,
) -> DataFrame:
    """Modeling table -> flags -> clean columns, with a stage boundary where a table is re-read.

    Only the listings with their flag of duplicates are stored (or nothing, when the modeling table is given): the other
    columns are joins with small stored tables (market cells, fills, bounds) and projections, of which a reader pays
    for those it takes.  With ``fit_on``, which may ask for any flag, the flagged table is stored as well.
    """
    if modeling is not None:
        ds = modeling
    elif fit_on is None and set(dup_cols) <= set(listings.columns):
        marked = materialize(quality.flag_duplicates(listings, list(dup_cols), "row_key"), mode)
        ds = market.modeling_dataset(marked, leases, sales)
    else:
        ds = materialize(market.modeling_dataset(listings, leases, sales), mode)
    flagged = quality.add_quality_flags(ds, dup_cols=list(dup_cols))
    if fit_on is None:
        return quality.add_clean_columns(flagged, rows_of=quality.add_row_flags(ds))
    flagged = materialize(flagged, mode)
    return quality.add_clean_columns(flagged, fit_on=fit_on, mode=mode)


def preprocess(
    listings: DataFrame, leases: DataFrame, sales: DataFrame, drop_sale_missing: bool = True, checkpoint: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(flagged, train-domain, out-of-domain, report)."""
    flagged = flagged_dataset(listings, leases, sales)
    if checkpoint:
        from fairlease.session import cut_lineage

        flagged = cut_lineage(flagged)
    else:
        flagged = flagged.persist(StorageLevel.MEMORY_AND_DISK)
    _, train, ood = quality.partition_quality(flagged, drop_sale_missing)
    report = quality.quality_report(listings, flagged, train, ood)
    return flagged, train, ood, report
