"""Group split, month folds, per-group samples, scoreboard upsert, best run.

Random choices are replaced by deterministic hashes (``md5(seed | key)``), so the
same input always gives the same split on any cluster layout and on retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlease.functions.columns import nan_to_null, norm_key, year_of_month
from fairlease.operators.quantiles import _null_safe_join
from fairlease.session import materialize

DEFAULT_GROUP_COLS = ("gu_code", "ym", "property_type")


def _hash_order(seed: int, cols: Sequence[str]):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[norm_key(c) for c in cols]))


# G4 ---------------------------------------------------------------------------
def group_split(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_GROUP_COLS,
    ym: str = "ym",
    fractions: tuple[float, float, float] = (0.70, 0.15, 0.15),
    seed: int = 42,
    out: str = "split",
) -> tuple[DataFrame, DataFrame]:
    """Year-stratified group split; every group lands wholly in one split.

    Per year: groups in hash order, the first floor(n x train) are train, the next
    floor(n x valid) valid, the rest test; with >= 3 groups each split gets at least
    one.  Works on the distinct-group table (one row per group, not per listing),
    so the per-year window never sees fact rows.  Returns (rows with ``split``, per-year report).
    """
    tr, va, te = fractions
    if abs(tr + va + te - 1.0) > 1e-9:
        raise ValueError("train_size + valid_size + test_size must equal 1.0")
    keys = list(keys)
    groups = df.select(*[F.col(k).cast("string").alias(k) for k in keys], year_of_month(F.col(ym).cast("string")).alias("_year")).distinct()
    w = Window.partitionBy("_year")
    g = groups.withColumn("_rn", F.row_number().over(w.orderBy(_hash_order(seed, keys + ["_year"])))).withColumn(
        "_n", F.count(F.lit(1)).over(w)
    )
    n = F.col("_n")
    n_train0, n_valid0 = F.floor(n * F.lit(tr)), F.floor(n * F.lit(va))
    n_train1 = F.when((n >= 3) & (n_train0 == 0), 1).otherwise(n_train0)
    n_valid1 = F.when((n >= 3) & (n_valid0 == 0), 1).otherwise(n_valid0)
    g = g.withColumns({"_ntr": n_train1, "_nva": n_valid1})
    g = g.withColumn(
        "_ntr", F.when((n >= 3) & (n - F.col("_ntr") - F.col("_nva") == 0), F.greatest(F.lit(1), F.col("_ntr") - 1)).otherwise(F.col("_ntr"))
    )
    g = g.withColumn(
        out,
        F.when(F.col("_rn") <= F.col("_ntr"), "train").when(F.col("_rn") <= F.col("_ntr") + F.col("_nva"), "valid").otherwise("test"),
    )
    split_map = materialize(g.select(*keys, "_year", out))  # a row a group: its size is known before the join
    report = split_map.groupBy(F.col("_year").alias("year")).agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col(out) == "train").alias("train_groups"),
        F.count_if(F.col(out) == "valid").alias("valid_groups"),
        F.count_if(F.col(out) == "test").alias("test_groups"),
    )
    # Join labels back to rows (null-safe); the split table is one row per group
    rows = df.withColumn("_year", year_of_month(F.col(ym).cast("string")))
    for k in keys:
        rows = rows.withColumn(f"_sk_{k}", F.col(k).cast("string"))
    sm = split_map.select(*[F.col(k).alias(f"_sk_{k}") for k in keys], "_year", out)
    labelled = _null_safe_join(rows, sm, [f"_sk_{k}" for k in keys] + ["_year"])
    return labelled.drop(*[f"_sk_{k}" for k in keys], "_year"), report


def assert_all_assigned(df: DataFrame, col: str = "split") -> None:
    """The reference raises if any row is left without a split; same check, one aggregate."""
    missing = df.filter(F.col(col).isNull()).limit(1).count()
    if missing:
        raise RuntimeError("failed to assign every row to a split")


# G5 ---------------------------------------------------------------------------
def month_folds(df: DataFrame, n_folds: int, ym: str = "ym") -> DataFrame:
    """(ym, fold) for contiguous month chunks; earlier chunks take the extra months (``ntile``).

    The window runs over the distinct months only (tens of rows).
    """
    months = df.select(ym).filter(F.col(ym).isNotNull()).distinct()
    n = months.count()
    if n < n_folds:
        raise ValueError(f"not enough months for {n_folds} folds: {n} months")
    return months.select(ym, (F.ntile(n_folds).over(Window.orderBy(ym)) - 1).cast("bigint").alias("fold"))


# G9 ---------------------------------------------------------------------------
def sample_per_group(df: DataFrame, key: str, n: int, seed: int = 42, order_key: str = "row_key") -> DataFrame:
    """Exactly min(n, group size) rows per group, the ones with the smallest ``md5(seed|order_key)``.

    A hot group is never ranked whole: rows are pre-filtered by a uniform hash
    threshold sized for ~n + 10·sqrt(n) + 10 expected survivors per group; the few
    groups where the filter kept fewer than needed are redone from all their rows.
    """
    h = _hash_order(seed, [order_key])
    sizes = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("_gn")))
    frac = F.least(F.lit(1.0), (F.lit(n + 10.0 * n**0.5 + 10.0)) / F.col("_gn"))
    tagged = _null_safe_join(df, sizes, [key]).withColumn("_h", h)
    cand = materialize(tagged.filter(F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / float(16**12) < frac))
    got = cand.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    short = _null_safe_join(sizes, got, [key]).filter(F.coalesce("_c", F.lit(0)) < F.least(F.col("_gn"), F.lit(n))).select(key)
    short = materialize(short)
    pool = cand
    if not short.isEmpty():
        redo = _null_safe_join(tagged, short, [key], "left_semi")
        pool = _null_safe_join(cand, short, [key], "left_anti").unionByName(redo)
    w = Window.partitionBy(key).orderBy("_h")  # ≤ n + O(sqrt n) candidates per group
    return pool.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn", "_h", "_gn")


def sample_global(df: DataFrame, n: int, seed: int = 42, order_key: str = "row_key") -> DataFrame:
    """Exactly min(n, rows) rows: those with the smallest ``md5(seed|order_key)``.

    Rows are pre-filtered by a hash threshold for about n + 10·sqrt(n) + 10 survivors, of which the n
    smallest are taken; should the filter have kept fewer than n (odds under 1e-20), all rows are ranked.
    """
    tagged = df.withColumn("_h", _hash_order(seed, [order_key]))
    rows = df.count()
    kept = tagged.filter(_hash_unit("_h", 1) < (n + 10.0 * n**0.5 + 10.0) / max(rows, 1))
    if rows <= n or kept.count() < n:
        kept = tagged
    return kept.orderBy("_h").limit(n).drop("_h")  # TakeOrdered: at most n rows a task


def _hash_unit(h, first: int):
    """A number in (0, 1) from 12 hex digits of a hash, from the ``first`` one (1-based)."""
    return (F.conv(F.substring(h, first, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def normal_jitter(cols: Sequence[str], salt: str, scale: float, seed: int = 42):
    """A normal deviate of standard deviation ``scale`` for each row, fixed by ``md5(seed|salt|cols)`` (Box-Muller)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[norm_key(c) for c in cols]))
    return F.lit(scale) * F.sqrt(-2.0 * F.log(_hash_unit(h, 1))) * F.cos(F.lit(2.0) * F.pi() * _hash_unit(h, 13))


#: Plot points a cluster, and the standard deviation of their jitter (m2; 100 million won).
PLOT_POINTS, AREA_JITTER, MEDIAN_JITTER = 350, 0.35, 0.025


def plot_points(df: DataFrame, cluster: str, area: str = "area_m2_clean", median: str = "rent_deposit_median", key: str = "row_key", n: int = PLOT_POINTS, seed: int = 42) -> DataFrame:
    """Jittered plot position (x, y) of up to ``n`` rows of each cluster; rows without a position are left out after sampling."""
    s = sample_per_group(df.select(key, cluster, area, median), cluster, n, seed, key)
    x = nan_to_null(area) + normal_jitter([key], "area", AREA_JITTER, seed)
    y = F.greatest(F.lit(0.0), nan_to_null(median) / 100_000_000 + normal_jitter([key], "median", MEDIAN_JITTER, seed))
    known = nan_to_null(area).isNotNull() & nan_to_null(median).isNotNull()
    return s.where(known).select(key, x.alias("x"), y.alias("y"), F.col(cluster).cast("string").alias("cluster_id"))


# G6 ---------------------------------------------------------------------------
# The scoreboard's columns and its key.
SCORE_COLUMNS = (
    "updated_at", "experiment", "run_name", "model", "split", "rmse", "mae", "r2", "target", "rows", "result_path", "notes",
)
SCORE_KEY_COLUMNS = ("experiment", "run_name", "model", "split", "target")


def upsert_scores(old: DataFrame | None, new: DataFrame, split_filter: str | None = "test") -> DataFrame:
    """Keyed upsert: new rows (only ``split_filter`` rows) replace old rows with the same key;
    within a batch the row with the larger ``_seq`` wins, without that column the one with the later
    ``updated_at`` (then the better score), never the physical order.  Missing columns are NULL."""

    def conform(df: DataFrame, batch: int) -> DataFrame:
        cols = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in SCORE_COLUMNS]
        if "run_name" not in df.columns:
            cols[SCORE_COLUMNS.index("run_name")] = F.lit("legacy").alias("run_name")
        seq = F.col("_seq").cast("long") if "_seq" in df.columns else F.lit(None).cast("long")
        return df.select(*cols, F.lit(batch).alias("_batch"), seq.alias("_seq"))

    if split_filter is not None:
        new = new.filter(F.col("split") == split_filter)
    frames = [conform(new, 1)] if old is None else [conform(old, 0), conform(new, 1)]
    allr = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)
    others = [F.col(c).asc_nulls_last() for c in ("rmse", "mae", "rows", "result_path", "notes")]
    w = Window.partitionBy(*SCORE_KEY_COLUMNS).orderBy(F.col("_batch").desc(), F.col("_seq").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), *others)
    kept = allr.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_batch", "_seq")
    return kept.orderBy(
        F.col("split").asc_nulls_last(), F.col("rmse").asc_nulls_last(), F.col("experiment").asc_nulls_last(),
        F.col("model").asc_nulls_last(),
    )


# G8 ---------------------------------------------------------------------------
def best_run(scores: DataFrame, experiment: str | None = None, model: str | None = None, split: str = "test") -> DataFrame:
    """Lowest rmse, then mae, then highest r2 (one row; TakeOrdered, no global sort)."""
    s = scores.filter(F.col("split") == split)
    if experiment is not None:
        s = s.filter(F.col("experiment") == experiment)
    if model is not None:
        s = s.filter(F.col("model") == model)
    return s.orderBy(F.col("rmse").asc(), F.col("mae").asc(), F.col("r2").desc()).limit(1)
