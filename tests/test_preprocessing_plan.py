"""Preprocessing stores narrow tables only, and its statistics are those of the flagged rows."""

from pyspark.sql import functions as F

from fairlease import session
from fairlease.operators import market, quality
from fairlease.operators.quantiles import group_percentiles
from fairlease.plans import preprocess

_NUMBERS = (
    "room_count", "area_m2", "household_size", "deposit_won", "support_won", "tenant_deposit_won", "monthly_rent_won", "deposit_per_m2",
    "support_ratio", "lh_vs_rent_median_ratio", "lh_vs_sale_median_ratio", "jeonse_to_sale_ratio_median",
)


def _modeling(spark):
    n = F.col("id") % 23  # every row has copies
    df = spark.range(92).select(
        "id", F.concat(F.lit("k"), F.col("id") % 90).alias("row_key"), F.lit("00001").alias("gu_code"), F.lit("g").alias("gu_name"), F.lit("1995-01").alias("ym"),
        F.to_date(F.lit("1995-01-02")).alias("contract_date"), F.when(n != 4, F.element_at(F.array(*map(F.lit, ("apt", "rh", "other"))), (n % 3 + 1).cast("int"))).alias("property_type"),
        F.concat(F.lit("h"), n % 2).alias("housing_type"), F.concat(F.lit("d"), n % 2).alias("detail_type"),
        *[F.when(n % (i + 3) != 0, (n * (i + 1)).cast("double")).alias(c) for i, c in enumerate(_NUMBERS)],
        F.when(n != 5, n).alias("sale_txn_count"), F.when(n != 6, n).alias("rent_txn_count"),
    )
    # zeros of both signs are equal, and so are NaNs
    return df.withColumn("area_m2", F.when(n == 2, F.when(F.col("row_key") < "k3", F.lit(0.0)).otherwise(F.lit(-0.0))).when(n == 7, F.lit(float("nan"))).otherwise(F.col("area_m2"))).drop("id")


def _rows(df):
    return sorted(str(r) for r in df.collect())


def test_only_the_modeling_table_is_stored_and_the_result_is_the_same(spark, monkeypatch):
    ds = _modeling(spark)
    want = quality.add_clean_columns(quality.add_quality_flags(ds, list(preprocess.CONTENT_COLUMNS)))
    stored = []
    keep = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: stored.append(df.columns) or keep(df))
    got = preprocess.flagged_dataset(None, None, None, modeling=ds)
    assert got.dtypes == want.dtypes
    assert stored and not any("row_key" in c for c in stored)
    assert _rows(got) == _rows(want)


def test_duplicates_by_brute_force(spark):
    ds = _modeling(spark)
    cols = ["property_type", "area_m2", "room_count"]
    rows = ds.select("row_key", *cols).collect()
    alike = lambda r: tuple("nan" if r[c] != r[c] else r[c] for c in cols)
    first = {}
    for r in rows:
        first[alike(r)] = min(first.get(alike(r), r["row_key"]), r["row_key"])
    want = sorted((r["row_key"], r["row_key"] != first[alike(r)]) for r in rows)
    got = quality.flag_duplicates(ds, cols, "row_key")
    assert got.columns == [*ds.columns, "is_exact_duplicate"]
    assert sorted((r["row_key"], r["is_exact_duplicate"]) for r in got.collect()) == want


def test_percentiles_of_a_column_share_a_value_map(spark):
    df = spark.range(101).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"), F.lit(None).cast("double").alias("none"))
    specs = [("lo", "v", 0.25), ("mid", "v", 0.5), ("again", "v", 0.5), ("hi", "v", 0.75), ("nothing", "none", 0.5)]
    out = group_percentiles(df, ["g"], specs, "hash")
    assert out.columns == ["g", "lo", "mid", "again", "hi", "nothing"]
    assert [tuple(r) for r in out.orderBy("g").collect()] == [(0, 25.0, 50.0, 50.0, 75.0, None), (1, 25.5, 50.0, 50.0, 74.5, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(") == 2


def _facts(spark):
    """Listings (every content comes several times, some keys too), leases and sales of a few cells."""
    keys = ["gu_code", "gu_name", "ym", "property_type"]
    ds = _modeling(spark)
    listings = ds.select("row_key", *preprocess.CONTENT_COLUMNS)
    cells = ds.select(*keys).distinct().crossJoin(spark.range(5).toDF("n"))
    leases = cells.select(*keys, F.when(F.col("n") > 1, "jeonse").otherwise("monthly").alias("rent_type"), *[(F.col("n") * i + 3).cast("double").alias(c) for i, c in enumerate(("deposit_won", "deposit_per_m2", "monthly_rent_won", "area_m2"), 1)])
    sales = cells.where("property_type <> 'rh'").select(*keys, *[(F.col("n") * i + 5).cast("double").alias(c) for i, c in enumerate(("sale_price_won", "sale_price_per_m2", "area_m2"), 1)])
    return listings, leases, sales


def test_rows_are_stored_once_with_their_flag_of_duplicates(spark, monkeypatch):
    listings, leases, sales = _facts(spark)
    ds = market.modeling_dataset(listings, leases, sales)
    want = quality.add_clean_columns(quality.add_quality_flags(ds, list(preprocess.CONTENT_COLUMNS)))
    stored = []
    keep = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: stored.append(df.columns) or keep(df))
    got = preprocess.flagged_dataset(listings, leases, sales)
    assert got.dtypes == want.dtypes
    assert [c for c in stored if "row_key" in c] == [[*listings.columns, "is_exact_duplicate"]]
    assert _rows(got) == _rows(want)
    # reading the result again finds no statistic anew
    before = len(stored)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(stored) == before and "percentile" not in plan and "Aggregate" not in plan


def test_rows_without_copies_are_not_joined_by_their_columns(spark):
    ds = _modeling(spark)
    out = quality.flag_duplicates(ds, ["property_type", "area_m2", "room_count"], "row_key")
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert len(joins) == 1 and joins[0].count("coalesce(") == 0  # null-safe keys would be dealt and sorted as coalesce() and isnull()
    single = ds.dropDuplicates(["property_type", "area_m2", "room_count"]).withColumn("row_key", F.lit(None).cast("string"))
    assert {r[0] for r in quality.flag_duplicates(single, ["property_type", "area_m2", "room_count"], "row_key").select("is_exact_duplicate").collect()} == {False}


def test_columns_decide_among_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    test_duplicates_by_brute_force(spark)
