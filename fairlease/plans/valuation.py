"""Entry points B and C: fit the final artefacts, then value listings in batch (K9) or as a stream.

Artefacts are DataFrames (lookup tables, the search trees of the reference's ranks) plus fitted
Spark ML models; scoring joins them to the listings (broadcast where the
table size is checked), so no listing is handled row by row on the driver.  Scoring is one
pass: no stage boundary, no join of the listings with themselves, no read of a training row.

``publish_artifacts`` writes a version under a root folder and marks it complete at the end;
``load_newest`` takes the newest complete one, so a reader never sees a half-written version.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlease.functions.columns import GRADE_BANDS, RISK_BANDS_SCORING, add_combo_features, band, clip, model_scope
from fairlease.operators import anomaly, lookup, models, quality, risk, splits
from fairlease.operators.rank_index import RankIndex, build_rank_index
from fairlease.session import materialize

RANKED = ("kmeans_distance", "isolation_score")
FINAL_SPEC = {"kind": "gbt", "maxDepth": 6, "maxIter": 40, "stepSize": 0.1, "subsamplingRate": 0.8}
CONFIDENCE = 0.95


@dataclass
class Artifacts:
    model: PipelineModel
    median_lookup: DataFrame
    interval_lookup: DataFrame
    unsup_design: PipelineModel
    centers: list
    cluster_map: DataFrame
    cluster_stats: DataFrame
    iforest: anomaly.IsolationForestModel
    ranks: RankIndex  # of the train rows' kmeans_distance / isolation_score
    metadata: dict = field(default_factory=dict)


def model_features(labelled: DataFrame) -> tuple[list[str], list[str]]:
    """(categorical, numeric) features of every model fit: all that are selected, combined keys included."""
    _features, cat, num = quality.final_features(add_combo_features(labelled.drop("target", "fold")))
    return cat, num


def _model_frame(df: DataFrame, cat, num, keep=("row_key", "target", "deposit_won", "split")) -> DataFrame:
    df = add_combo_features(df)
    return models.categorical_frame(df, [*cat, *num], cat, num, keep=[*keep, *df.columns])


def fit_artifacts(labelled: DataFrame, k: int = 12, restarts: int = 20, trees: int = anomaly.IFOREST_TREES, seed: int = 42, alpha: float = 1 - CONFIDENCE, spec: dict | None = None) -> Artifacts:
    """``labelled``: training rows with ``target`` and ``split`` (train / valid / test).  ``spec`` is the
    learner to fit, e.g. the one that ``best_run`` found; every selected feature goes into it."""
    train = labelled.filter(F.col("split") == "train")
    valid = labelled.filter(F.col("split") == "valid")
    cat, num = model_features(labelled)
    framed = lambda df: _model_frame(df, cat=cat, num=num)
    model = models.fit_model(framed(train), framed(valid), cat, num, spec or FINAL_SPEC, "target", seed)
    # conformal half-widths from validation residuals (I11 -> E4), lease-median lookup from all rows
    vpred = model.transform(framed(valid)).withColumn("abs_residual", F.abs(F.col("target") - F.col("prediction")))
    interval_lk = materialize(lookup.build_interval_lookup(vpred, "abs_residual", alpha=alpha))
    median_lk = materialize(lookup.build_median_lookup(labelled, "rent_deposit_median"))
    # unsupervised: design -> k-means (restarts) -> merge small -> robust z -> isolation forest
    u = anomaly.unsupervised_frame(train)
    design = models.design_pipeline(anomaly.UNSUP_CAT, anomaly.UNSUP_NUM).fit(models.categorical_frame(u, [*anomaly.UNSUP_CAT, *anomaly.UNSUP_NUM], anomaly.UNSUP_CAT, anomaly.UNSUP_NUM, keep=["row_key"]))
    ux = materialize(design.transform(models.categorical_frame(u, [*anomaly.UNSUP_CAT, *anomaly.UNSUP_NUM], anomaly.UNSUP_CAT, anomaly.UNSUP_NUM, keep=["row_key"])))
    km = anomaly.fit_kmeans(ux, k, restarts, seed)
    centers = [c.tolist() for c in km.clusterCenters()]
    assigned = km.transform(ux)
    cmap = anomaly.merge_small_clusters(assigned, centers, "cluster", min_rows=max(1, anomaly.MIN_CLUSTER_ROWS))
    assigned = assigned.join(F.broadcast(cmap), assigned["cluster"] == cmap["raw_cluster"]).drop("raw_cluster")
    # stored, as every statistic of the distances and the forest read them
    assigned = materialize(anomaly.centroid_distance(assigned, centers, "features", "merged_cluster").select("row_key", "features", "merged_cluster", "kmeans_distance"))
    _, zstats = anomaly.robust_z(assigned, "merged_cluster", "kmeans_distance")
    forest = anomaly.fit_isolation_forest(ux, "features", "row_key", n_trees=trees, seed=seed)
    ref = forest.score_frame(assigned.select("row_key", "features", "kmeans_distance"), "features").drop("features")
    ranks = build_rank_index(materialize(ref), RANKED)
    meta = {"confidence_level": CONFIDENCE, "features": cat + num, "cat_cols": cat, "num_cols": num, "k": k, "trees": trees}
    return Artifacts(model, median_lk, interval_lk, design, centers, cmap, zstats, forest, ranks, meta)


def value_listings(listings: DataFrame, art: Artifacts) -> DataFrame:
    """Per listing: filled lease median and source, fair deposit with 95 % band, cluster and anomaly
    scores, price scores, scope and labels (K4-K9).  Every step is per-row against static
    artefacts, so the batch and the stream give identical rows."""
    df = lookup.hierarchical_lookup(listings, art.median_lookup, "median", "rent_deposit_median", "rent_deposit_median_source", keep_existing=True, mode="none")
    # the design gets its own view of the features; the listing keeps its columns as they came
    given, cat, num = df.columns, art.metadata["cat_cols"], art.metadata["num_cols"]
    framed = models.categorical_frame(add_combo_features(df).withColumn("__listing", F.struct(*given)), [*cat, *num], cat, num, keep=["__listing"])
    scored = art.model.transform(framed)
    absent = [c for c in num if c not in given]
    df = scored.select("__listing.*", *absent, F.col("prediction").alias("predicted_log_ratio"))
    df = lookup.hierarchical_lookup(df, art.interval_lookup, "q", "interval_q", "interval_source", mode="none")
    df = risk.prediction_interval(df)
    # unsupervised scores, beside the listing
    given = df.columns
    u = anomaly.unsupervised_frame(df.withColumn("__listing", F.struct(*given)))
    ucols = [*anomaly.UNSUP_CAT, *anomaly.UNSUP_NUM]
    ux = art.unsup_design.transform(models.categorical_frame(u, ucols, anomaly.UNSUP_CAT, anomaly.UNSUP_NUM, keep=["__listing"]))
    ux = anomaly.centroid_distance(ux.select("__listing", "features"), art.centers, "features", None, "raw_distance")
    ux = ux.join(F.broadcast(art.cluster_map), ux["cluster"] == art.cluster_map["raw_cluster"], "left")
    ux = anomaly.centroid_distance(ux, art.centers, "features", "merged_cluster")
    scores = (*RANKED, "cluster_id")
    ux = art.iforest.score_frame(ux.withColumn("cluster_id", F.col("display_cluster")), "features")
    ux = ux.select(*[F.col("__listing")[c].alias(c) for c in given if c not in scores], *scores)
    df = risk.anomaly_score(ux, art.ranks)
    df = risk.plot_coords(risk.price_score(df))
    df = model_scope(df)
    return df.withColumns(
        {
            "risk_probability_percent": clip("overprice_score", 0, 100),
            "price_risk_grade": band("overprice_score", GRADE_BANDS),
            "anomaly_grade": band("anomaly_percentile", GRADE_BANDS),
            "risk_label": band(clip("overprice_score", 0, 100), RISK_BANDS_SCORING),
            "confidence_level": F.lit(art.metadata.get("confidence_level", CONFIDENCE)),
        }
    )


VALUATION_COLUMNS = (
    "row_key", "rent_deposit_median", "rent_deposit_median_source", "predicted_log_ratio", "interval_q", "interval_source",
    "predicted_fair_deposit_won", "fair_deposit_lower_95_won", "fair_deposit_upper_95_won", "cluster_id", "kmeans_distance",
    "isolation_score", "anomaly_percentile", "overprice_score", "model_scope_status", "risk_label", "price_risk_grade", "anomaly_grade",
)


TABLES = ("median_lookup", "interval_lookup", "cluster_map", "cluster_stats")


def save_artifacts(art: Artifacts, path: str) -> str:
    """Everything that scoring needs, as tables and Spark ML models under one folder."""
    spark = art.median_lookup.sparkSession
    art.model.write().overwrite().save(f"{path}/model")
    art.unsup_design.write().overwrite().save(f"{path}/unsup_design")
    for name in TABLES:
        getattr(art, name).write.mode("overwrite").parquet(f"{path}/{name}")
    art.ranks.nodes.write.mode("overwrite").parquet(f"{path}/rank_nodes")
    spark.createDataFrame(art.iforest.nodes).write.mode("overwrite").parquet(f"{path}/iforest")
    meta = art.metadata | {"centers": [list(map(float, c)) for c in art.centers], "iforest_psi": art.iforest.psi, "iforest_offset": art.iforest.offset, "ranks": art.ranks.heads}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "metadata string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return path


def load_artifacts(spark: SparkSession, path: str) -> Artifacts:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    forest = anomaly.IsolationForestModel(spark.read.parquet(f"{path}/iforest").toPandas(), meta.pop("iforest_psi"), meta.pop("iforest_offset"))  # trees x nodes
    centers, ranks = meta.pop("centers"), RankIndex(spark.read.parquet(f"{path}/rank_nodes"), meta.pop("ranks"))
    return Artifacts(
        PipelineModel.load(f"{path}/model"), tables["median_lookup"], tables["interval_lookup"], PipelineModel.load(f"{path}/unsup_design"),
        centers, tables["cluster_map"], tables["cluster_stats"], forest, ranks, meta,
    )


COMPLETE = "_COMPLETE"


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def publish_artifacts(art: Artifacts, root: str) -> str:
    """A new version under ``root``: its own folder, marked complete by one empty file once everything is in it.

    Versions sort by the time they were begun; a failed writer leaves an unmarked folder that no reader takes.
    """
    spark = art.median_lookup.sparkSession
    path = f"{root.rstrip('/')}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    save_artifacts(art, path)
    fs, marker = _folder(spark, f"{path}/{COMPLETE}")
    fs.create(marker, False).close()
    return path


def newest_version(spark: SparkSession, root: str) -> str | None:
    """The newest complete version under ``root``; None without one."""
    fs, pattern = _folder(spark, f"{root.rstrip('/')}/v*/{COMPLETE}")
    found = [str(s.getPath().getParent().toString()) for s in fs.globStatus(pattern) or []]
    return max(found, key=lambda p: p.rsplit("/", 1)[1], default=None)


def load_newest(spark: SparkSession, root: str) -> Artifacts:
    path = newest_version(spark, root)
    if path is None:
        raise FileNotFoundError(f"no complete version under {root}")
    return load_artifacts(spark, path)


def spec_registry(spark: SparkSession, specs: Mapping[str, Mapping]) -> DataFrame:
    """(model, spec): one row a learner, its parameters as JSON."""
    return spark.createDataFrame([(name, json.dumps(dict(spec), sort_keys=True)) for name, spec in specs.items()], "model string, spec string")


def chosen_spec(scores: DataFrame, registry: DataFrame, experiment: str | None = None) -> tuple[str, dict]:
    """(model, spec) of the scoreboard's best test run among the registered learners."""
    known = scores.join(registry.select("model"), "model", "left_semi")
    best = splits.best_run(known, experiment).join(registry, "model").select("model", "spec").first()
    if best is None:
        raise ValueError("no registered learner has a test run on the scoreboard")
    return best["model"], json.loads(best["spec"])


def fit_best(labelled: DataFrame, scores: DataFrame, registry: DataFrame, root: str, experiment: str | None = None, **fit) -> str:
    """Fit the learner of the best run with everything else that scoring needs, and publish it under ``root``."""
    name, spec = chosen_spec(scores, registry, experiment)
    art = fit_artifacts(labelled, spec=spec, **fit)
    art.metadata |= {"model": name, "spec": spec}
    return publish_artifacts(art, root)


def training_target(flagged: DataFrame) -> DataFrame:
    return quality.training_rows(quality.train_domain(flagged), quality.TARGET).withColumn("target", F.col(quality.TARGET))
