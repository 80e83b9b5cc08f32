"""Price-risk outputs, disagreement, risk index, intervals, price scores.

Everything here is a column expression over already-joined inputs, plus the
distributed ranks from :mod:`fairlease.operators.ranks` where a percentile
against a reference sample is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlease.functions.columns import RISK_BANDS_TRAINING, band, clip, log1p_clipped, nan_to_null, row_mean, row_std, safe_ratio
from fairlease.operators import anomaly
from fairlease.operators.ensemble import prediction_suffix
from fairlease.operators.quantiles import global_percentiles
from fairlease.operators.rank_index import RankIndex, build_rank_index
from fairlease.operators.ranks import average_ranks, ref_percentile, ref_percentiles, topk_capture
from fairlease.operators.stats import regression_metrics
from fairlease.session import materialize

# Fixed values (risk index blends, score calibration, clip).
INDEX_WEIGHTS = {"ratio": 0.85, "disagreement": 0.15}
INDEX_WEIGHTS_UNSUP = {"ratio": 0.60, "unsupervised": 0.30, "disagreement": 0.10}
UNSUPERVISED_RISK_CLIP = 5.0
HIGH_PRICE = (1.05, 0.25)  # (start, width) for asking/fair ratio
LOW_PRICE = (0.85, 0.30)
UPPER_PRICE = (1.00, 0.20)  # asking / upper 95 % bound
ANOMALY_WEIGHTS = {"kmeans": 0.55, "isolation": 0.45}


# K1 ---------------------------------------------------------------------------
def add_price_risk(df: DataFrame, preds: Sequence[str]) -> DataFrame:
    """Per prediction: ratio = expm1, batch percentile (average ranks), fair deposit, gap, gap ratio,
    index = 100 x percentile, label."""
    preds = [p for p in preds if p in df.columns]
    out = df.withColumns({f"predicted_ratio_{prediction_suffix(p)}": F.expm1(p) for p in preds}) if preds else df
    if preds:  # all predictions ranked in one pass
        out = average_ranks(out, {f"predicted_ratio_{prediction_suffix(p)}": f"predicted_ratio_percentile_{prediction_suffix(p)}" for p in preds}, pct=True, null_value=0.0)
    for p in preds:
        s = prediction_suffix(p)
        if "rent_deposit_median" in out.columns:
            fair = F.col("rent_deposit_median") * F.col(f"predicted_ratio_{s}")
            out = out.withColumn(f"predicted_fair_deposit_won_{s}", fair)
            if "deposit_won" in out.columns:
                out = out.withColumns(
                    {
                        f"deposit_gap_won_{s}": F.col("deposit_won") - F.col(f"predicted_fair_deposit_won_{s}"),
                        f"deposit_gap_ratio_{s}": safe_ratio("deposit_won", f"predicted_fair_deposit_won_{s}"),
                    }
                )
        out = out.withColumn(f"risk_judgment_index_{s}", 100 * F.col(f"predicted_ratio_percentile_{s}"))
        out = out.withColumn(f"risk_label_{s}", band(f"risk_judgment_index_{s}", RISK_BANDS_TRAINING))
    return out


# K2 ---------------------------------------------------------------------------
def _disagreement(df: DataFrame, preds: Sequence[str]) -> DataFrame:
    return df.withColumn("model_disagreement_score", row_std(preds) if preds else F.lit(0.0))


def model_disagreement(valid: DataFrame, test: DataFrame, preds: Sequence[str], key: str | None = None) -> DataFrame:
    """Row std (ddof=1) across base predictions (0 with none) and its percentile against the valid rows."""
    return ref_percentile(_disagreement(test, preds), "model_disagreement_score", _disagreement(valid, preds), "model_disagreement_score", "model_disagreement_percentile")


# J10 --------------------------------------------------------------------------
def _robust_center_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with, per column, median (``__c_<col>``) and scale (``__s_<col>``) = IQR, or population
    std + 1e-9 when the IQR is ~0.  All columns in one percentile pass and one moments aggregate."""
    cols = list(cols)
    specs = []
    for c in cols:
        specs += [(f"__med_{c}", c, 0.5), (f"__q25_{c}", c, 0.25), (f"__q75_{c}", c, 0.75)]
    q = global_percentiles(df.select(*cols), specs)
    sd = df.agg(*[F.stddev_pop(nan_to_null(c)).alias(f"__sd_{c}") for c in cols])
    out = []
    for c in cols:
        iqr = F.col(f"__q75_{c}") - F.col(f"__q25_{c}")
        out += [F.col(f"__med_{c}").alias(f"__c_{c}"), F.when(iqr > 1e-9, iqr).otherwise(F.col(f"__sd_{c}") + 1e-9).alias(f"__s_{c}")]
    return q.crossJoin(sd).select(*out)


def unsupervised_risk(valid: DataFrame, test: DataFrame, cols: Sequence[str], clip_at: float = UNSUPERVISED_RISK_CLIP):
    """Sum of per-score robust z (centre/scale fitted on valid), re-scaled by the valid sum's robust
    centre/scale; raw kept, final clipped to ±clip.  Returns (valid, test)."""
    stats = _robust_center_scale(valid, cols)
    z = {f"{c}_risk_z": (F.col(c) - F.col(f"__c_{c}")) / F.col(f"__s_{c}") for c in cols}
    total = sum((F.coalesce(F.col(f"{c}_risk_z"), F.lit(0.0)) for c in cols), F.lit(0.0))

    def apply(df):
        out = df.crossJoin(F.broadcast(stats)).withColumns(z).withColumn("__sum", total)
        return out.drop(*[f"__c_{c}" for c in cols], *[f"__s_{c}" for c in cols])

    v, t = apply(valid), apply(test)
    fin = _robust_center_scale(v, ["__sum"])

    def finish(df):
        out = df.crossJoin(F.broadcast(fin)).withColumn(
            "unsupervised_risk_score_raw", (F.col("__sum") - F.col("__c___sum")) / F.col("__s___sum")
        )
        out = out.withColumn("unsupervised_risk_score", clip("unsupervised_risk_score_raw", -clip_at, clip_at))
        return out.drop("__sum", "__c___sum", "__s___sum")

    return finish(v), finish(t)


# K3 ---------------------------------------------------------------------------
def risk_index(valid: DataFrame, test: DataFrame, base: str | Sequence[str], tree_preds: Sequence[str], unsup: str | None = "unsupervised_risk_score") -> DataFrame:
    """Risk judgment index on the test rows for each prediction of ``base``: its ratio percentile vs valid blended with
    model disagreement (0.85 / 0.15) and, with an unsupervised score, 0.60 / 0.30 / 0.10.  All bases are ranked in one pass."""
    bases = [base] if isinstance(base, str) else list(base)
    ratios = {f"predicted_ratio_{prediction_suffix(b)}": F.expm1(b) for b in bases}
    measured = lambda df: materialize(_disagreement(df.withColumns(ratios), tree_preds))
    valid, test = measured(valid), measured(test)
    # an empty valid split ranks everything at 0, as no value is above none
    least = 1.0 if valid.limit(1).count() else 0.0
    specs = [("model_disagreement_score", "model_disagreement_score", "model_disagreement_percentile", least)]
    if unsup:
        specs.append((unsup, unsup, "unsupervised_risk_percentile", least))
    specs += [(r, r, r.replace("predicted_ratio_", "predicted_ratio_percentile_", 1), least) for r in ratios]
    out = ref_percentiles(test, valid, specs)
    for name, s, idx in _variants(bases, bool(unsup)):
        out = out.withColumn(f"risk_judgment_index_{name}", idx).withColumn(f"risk_label_{name}", band(f"risk_judgment_index_{name}", RISK_BANDS_TRAINING))
        if "rent_deposit_median" in out.columns:
            out = out.withColumn(f"predicted_fair_deposit_won_{name}", F.col("rent_deposit_median") * F.col(f"predicted_ratio_{s}"))
            if "deposit_won" in out.columns:
                out = out.withColumns(
                    {
                        f"deposit_gap_won_{name}": F.col("deposit_won") - F.col(f"predicted_fair_deposit_won_{name}"),
                        f"deposit_gap_ratio_{name}": safe_ratio("deposit_won", f"predicted_fair_deposit_won_{name}"),
                    }
                )
    return out


def _variants(bases: Sequence[str], unsup: bool) -> list[tuple]:
    """(variant, base suffix, index) of every base, without and with the unsupervised score."""
    out = []
    for s in map(prediction_suffix, bases):
        ratio, apart = F.col(f"predicted_ratio_percentile_{s}"), F.col("model_disagreement_percentile")
        out.append((s, s, 100 * (INDEX_WEIGHTS["ratio"] * ratio + INDEX_WEIGHTS["disagreement"] * apart)))
        if unsup:
            w = INDEX_WEIGHTS_UNSUP
            out.append((f"unsupervised_{s}", s, 100 * (w["ratio"] * ratio + w["unsupervised"] * F.col("unsupervised_risk_percentile") + w["disagreement"] * apart)))
    return out


#: The top shares whose capture is reported.
CAPTURE_SHARES = (0.10, 0.20)


def risk_report(indexed: DataFrame, base: str | Sequence[str], target: str = "target", unsup: bool = True, key: str = "row_key") -> DataFrame:
    """One row a variant of :func:`risk_index`'s output: the base's prediction metrics, and how the index follows the target
    (Pearson, Spearman, share of the top tenth and fifth of targets among the top tenth and fifth of indices).

    All variants are ranked together: one shuffle of their values, one of (variant, key) rows."""
    bases = [base] if isinstance(base, str) else list(base)
    variants = [(name, b, f"risk_judgment_index_{name}") for b in bases for name in ([prediction_suffix(b), f"unsupervised_{prediction_suffix(b)}"] if unsup else [prediction_suffix(b)])]
    cols = [target, *[c for _, _, c in variants]]
    rows = materialize(indexed.select(key, *cols, *[b for b in bases if b not in cols]))
    base_metrics = regression_metrics(rows, target, bases).withColumnRenamed("model", "base")
    ranked = average_ranks(rows.select(*cols), {c: f"rank_{i}" for i, c in enumerate(cols)})
    agreed = ranked.agg(*[x for i, (_, _, c) in enumerate(variants, 1) for x in (F.corr(target, c).alias(f"p{i}"), F.corr("rank_0", f"rank_{i}").alias(f"s{i}"))])
    entry = [F.struct(F.lit(name).alias("variant"), F.lit(b).alias("base"), F.col(f"p{i}").alias("risk_pearson"), F.col(f"s{i}").alias("risk_spearman")) for i, (name, b, _) in enumerate(variants, 1)]
    agreed = agreed.select(F.explode(F.array(*entry)).alias("e")).select("e.*")
    held = None
    for name, _, c in variants:
        own = topk_capture(rows, target, c, key, CAPTURE_SHARES).select(F.lit(name).alias("variant"), *[F.col(f"top_{round(100 * f)}pct_capture").alias(f"top{round(100 * f)}_capture_rate") for f in CAPTURE_SHARES])
        held = own if held is None else held.unionByName(own)
    return agreed.join(F.broadcast(base_metrics), "base").join(F.broadcast(held), "variant").select(
        "variant", "base", "n", "rmse", "mae", "r2", "risk_pearson", "risk_spearman", *[f"top{round(100 * f)}_capture_rate" for f in CAPTURE_SHARES]
    )


# K5 ---------------------------------------------------------------------------
def prediction_interval(df: DataFrame, pred: str = "predicted_log_ratio", q: str = "interval_q") -> DataFrame:
    """expm1(pred ± q) ratio bounds and fair-deposit bounds in won."""
    out = df.withColumns(
        {
            "predicted_ratio": F.expm1(pred),
            "predicted_ratio_lower_95": F.expm1(F.col(pred) - F.col(q)),
            "predicted_ratio_upper_95": F.expm1(F.col(pred) + F.col(q)),
        }
    )
    return out.withColumns(
        {
            "predicted_fair_deposit_won": F.col("rent_deposit_median") * F.col("predicted_ratio"),
            "fair_deposit_lower_95_won": F.col("rent_deposit_median") * F.col("predicted_ratio_lower_95"),
            "fair_deposit_upper_95_won": F.col("rent_deposit_median") * F.col("predicted_ratio_upper_95"),
        }
    )


# K6 ---------------------------------------------------------------------------
def price_score(df: DataFrame, asking: str = "deposit_won") -> DataFrame:
    """Over/under-price scores 0-100 from asking / fair and asking / upper bound; overprice = max."""
    a = nan_to_null(asking)
    fair_ratio = safe_ratio(a, "predicted_fair_deposit_won")
    upper_ratio = safe_ratio(a, "fair_deposit_upper_95_won")
    high = F.coalesce(clip((fair_ratio - HIGH_PRICE[0]) / HIGH_PRICE[1] * 100, 0, 100), F.lit(0.0))
    low = F.coalesce(clip((LOW_PRICE[0] - fair_ratio) / LOW_PRICE[1] * 100, 0, 100), F.lit(0.0))
    upper = F.coalesce(clip((upper_ratio - UPPER_PRICE[0]) / UPPER_PRICE[1] * 100, 0, 100), F.lit(0.0))
    return df.withColumns(
        {
            "deposit_gap_won": a - F.col("predicted_fair_deposit_won"),
            "deposit_gap_ratio": fair_ratio,
            "high_price_score": high,
            "low_price_score": low,
            "overprice_score": F.greatest(high, low, upper),
        }
    )


# K7 ---------------------------------------------------------------------------
def anomaly_score(df: DataFrame, ref: DataFrame | RankIndex, kmeans_col: str = "kmeans_distance", iso_col: str = "isolation_score") -> DataFrame:
    """Percentiles and calibrated tail scores of k-means distance and isolation score against a
    reference sample; anomaly = 0.55 k-means tail + 0.45 isolation tail, raw = mean of percentiles.

    ``ref``: the reference rows, or the index of their ranks that a scorer keeps."""
    index = ref if isinstance(ref, RankIndex) else build_rank_index(ref, [kmeans_col, iso_col])
    out = index.percentiles(df, [(kmeans_col, kmeans_col, "__kp", 0.0), (iso_col, iso_col, "__ip", 0.0)])
    out = index.tail_scores(out, [(kmeans_col, kmeans_col, "__kp", "kmeans_tail_score"), (iso_col, iso_col, "__ip", "isolation_tail_score")])
    out = out.withColumns({"kmeans_distance_percentile": 100 * F.col("__kp"), "isolation_score_percentile": 100 * F.col("__ip")}).drop("__kp", "__ip")
    return out.withColumns(
        {
            "anomaly_raw_percentile": row_mean(["kmeans_distance_percentile", "isolation_score_percentile"]),
            "anomaly_percentile": clip(
                ANOMALY_WEIGHTS["kmeans"] * F.col("kmeans_tail_score") + ANOMALY_WEIGHTS["isolation"] * F.col("isolation_tail_score"), 0, 100
            ),
        }
    )


# K8 ---------------------------------------------------------------------------
def plot_coords(df: DataFrame, layout: Mapping | None = None, vec: str = "features", x: str = "area_m2_clean", y: str = "rent_deposit_median") -> DataFrame:
    """Plot position of every row, by what the artefacts' ``layout`` holds, in this order:

    ``axes``: area, and the lease median in 100-million-won units (also without a layout); ``points`` (feature vectors,
    positions): inverse-distance mean of the nearest plot points; ``pca``: a fitted (scaler, PCA) pair over ``vec``;
    nothing of these: area, and the log of the lease median."""
    if layout is None or layout.get("axes"):
        return df.withColumns({"cluster_x": nan_to_null(x), "cluster_y": nan_to_null(y) / 100_000_000})
    if "points" in layout:
        return anomaly.idw_project(df, vec, *layout["points"])
    if "pca" in layout:
        return anomaly.project_2d(df, layout["pca"], "cluster_x", "cluster_y")
    return df.withColumns({"cluster_x": nan_to_null(x), "cluster_y": log1p_clipped(nan_to_null(y))})
