"""Feature encoding and supervised learners.

Learners are ``pyspark.ml`` estimators trained in the executors (distributed
GBT / random forest); no row data is pulled to the driver.  The boosted-tree
libraries of the reference are re-aimed at Spark's tree ensembles.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlease.functions.columns import MISSING, nan_to_null
from fairlease.operators.quantiles import global_percentiles
from fairlease.session import cut_lineage, materialize


# H2 ---------------------------------------------------------------------------
def categorical_frame(df: DataFrame, features: Sequence[str], cat: Sequence[str], num: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Features only: categoricals as strings with ``__MISSING__``, numerics as double (NaN -> NULL),
    absent features added as NULL."""
    cols = []
    for c in features:
        if c in cat:
            src = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
            cols.append(F.coalesce(src, F.lit(MISSING)).alias(c))
        elif c in num:
            src = nan_to_null(F.col(c).cast("double")) if c in df.columns else F.lit(None).cast("double")
            cols.append(src.alias(c))
    kept = [k for k in dict.fromkeys(keep) if k in df.columns and k not in features]
    return df.select(*kept, *cols)


# H1 ---------------------------------------------------------------------------
class Design:
    """Numeric median fill (+ standardise), categorical index with unseen -> extra slot (+ sparse one-hot).

    Categoricals must already carry ``__MISSING__`` for NULL (see :func:`categorical_frame`).
    Medians are exact, the deviation is the population's (0 -> 1); a column without any value is
    filled with 0.  ``fit`` returns a :class:`PipelineModel`, which Spark ML can save.
    """

    def __init__(self, cat: Sequence[str], num: Sequence[str], one_hot: bool = True, scale: bool = True, output: str = "features", max_categories: int = 256):
        self.cat, self.num, self.one_hot, self.scale, self.output, self.max_categories = list(cat), list(num), one_hot, scale, output, max_categories

    def numeric_stats(self, df: DataFrame) -> dict[str, tuple[float, float, float]]:
        """Column to (median, mean, deviation) of the filled values; without ``scale`` (median, 0, 1)."""
        if not self.num:
            return {}
        med = global_percentiles(df.select(*self.num), [(c, c, 0.5) for c in self.num]).first()
        fill = {c: float(med[c]) if med[c] is not None else 0.0 for c in self.num}
        if not self.scale:  # a tree needs no mean: a pass over the rows less
            return {c: (fill[c], 0.0, 1.0) for c in self.num}
        filled = {c: F.coalesce(nan_to_null(c), F.lit(fill[c])) for c in self.num}
        ms = df.agg(*[F.avg(filled[c]).alias(f"a_{c}") for c in self.num], *[F.stddev_pop(filled[c]).alias(f"s_{c}") for c in self.num]).first()
        return {c: (fill[c], float(ms[f"a_{c}"] or 0.0), float(ms[f"s_{c}"] or 0.0) or 1.0) for c in self.num}

    def fit(self, df: DataFrame) -> PipelineModel:
        stages = []
        stats = self.numeric_stats(df)
        if self.num:
            value = lambda c: f"coalesce(nanvl(cast(`{c}` as double), null), {stats[c][0]!r}D)"
            shaped = {c: f"({value(c)} - {stats[c][1]!r}D) / {stats[c][2]!r}D" if self.scale else value(c) for c in self.num}
            stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"{shaped[c]} AS `{c}__imp`" for c in self.num) + " FROM __THIS__"))
            stages.append(VectorAssembler(inputCols=[f"{c}__imp" for c in self.num], outputCol="__num", handleInvalid="keep"))
        parts = ["__num"] if self.num else []
        idx = [f"{c}__idx" for c in self.cat]
        if self.cat:
            indexer = StringIndexer(inputCols=self.cat, outputCols=idx, handleInvalid="keep", stringOrderType="frequencyDesc").fit(df)
            stages.append(indexer)
            if self.one_hot:
                oh = [f"{c}__oh" for c in self.cat]
                stages.append(OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=False, handleInvalid="keep").fit(indexer.transform(df)))
                parts += oh
            else:
                # more categories than a tree should split by: their frequency order as a number
                many = [c for c, labels in zip(idx, indexer.labelsArray, strict=True) if len(labels) > self.max_categories]
                if many:
                    stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"`{c}` + 0D AS `{c}__ord`" for c in many) + " FROM __THIS__"))
                parts += [f"{c}__ord" if c in many else c for c in idx]
        stages.append(VectorAssembler(inputCols=parts, outputCol=self.output, handleInvalid="keep"))
        return PipelineModel(stages=stages)


SCRATCH = ("__imp", "__idx", "__oh", "__ord", "__te")


def drop_scratch(df: DataFrame) -> DataFrame:
    """Without the columns that a fitted design leaves beside its output."""
    return df.drop(*[c for c in df.columns if c.endswith(SCRATCH) or c in ("features", "__num", "__numeric", "__is_valid")])


def design_pipeline(cat: Sequence[str], num: Sequence[str], one_hot: bool = True, scale: bool = True, output: str = "features") -> Design:
    return Design(cat, num, one_hot, scale, output)


# H3 ---------------------------------------------------------------------------
def fit_ordinal(df: DataFrame, cat: Sequence[str], num: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Ordinal maps (column, value, code): UNKNOWN=0, MISSING=1, sorted values from 2; and numeric
    stats (column, median, mean, std with ddof 0, 0 -> 1)."""
    maps = None
    for c in cat:
        vals = df.select(F.col(c).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
        m = sorted_codes(vals).select(F.lit(c).alias("column"), "value", (F.col("position") + 1).alias("code"))
        maps = m if maps is None else maps.unionByName(m)
    stats = None
    for c in num:
        med = global_percentiles(df.select(c), [("median", c, 0.5)])
        filled = df.select(c).crossJoin(F.broadcast(med)).select(F.coalesce(nan_to_null(c), F.col("median")).alias("v"))
        ms = filled.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
        s = med.crossJoin(ms).select(F.lit(c).alias("column"), "median", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("std"))
        stats = s if stats is None else stats.unionByName(s)
    return maps, stats


def sorted_codes(values: DataFrame) -> DataFrame:
    """``value`` and its 1-based position in sort order; values are distinct and may be many.

    Sorted in ranges whose ids a checkpoint pins; a range's rows are numbered on their own and shifted
    by the sizes of the ranges before.
    """
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(values.repartitionByRange(n, "value").withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy("value"))
    return ranged.withColumn("__k", own).join(F.broadcast(starts), "__p").select("value", (F.col("__start") + F.col("__k")).alias("position"))


def apply_ordinal(df: DataFrame, maps: DataFrame, stats: DataFrame, cat: Sequence[str], num: Sequence[str]) -> DataFrame:
    """Codes by a join per categorical (map tables are one row per distinct value, no hint: Spark
    broadcasts what it has measured to be small); numerics filled with the median then standardised."""
    out = df
    for c in cat:
        m = maps.filter(F.col("column") == c).select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__c_{c}"))
        out = out.join(m, F.col(c).cast("string") == F.col(f"__v_{c}"), "left")
        out = out.withColumn(f"{c}_code", F.when(F.col(c).isNull(), 1).otherwise(F.coalesce(F.col(f"__c_{c}"), F.lit(0)))).drop(f"__v_{c}", f"__c_{c}")
    for c in num:
        s = F.broadcast(stats.filter(F.col("column") == c).select(F.col("median").alias("__m"), F.col("mean").alias("__a"), F.col("std").alias("__s")))
        out = out.crossJoin(s).withColumn(f"{c}_scaled", (F.coalesce(nan_to_null(c), F.col("__m")) - F.col("__a")) / F.col("__s")).drop("__m", "__a", "__s")
    return out


# H4 ---------------------------------------------------------------------------
def encode_categoricals(train: DataFrame, cols: Sequence[str], label: str, smoothing: float = 1.0):
    """Target encoding for high-cardinality categoricals (fit on training rows only)."""
    from pyspark.ml.feature import TargetEncoder

    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}__idx" for c in cols], handleInvalid="keep").fit(train)
    te = TargetEncoder(
        inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}__te" for c in cols], labelCol=label,
        targetType="continuous", smoothing=smoothing, handleInvalid="keep",
    ).fit(idx.transform(train))
    return PipelineModel(stages=[idx, te])


def out_of_fold_encoding(train: DataFrame, cols: Sequence[str], label: str, folds: DataFrame, fold_on: str = "ym", smoothing: float = 20.0) -> DataFrame:
    """``<c>__te`` for training rows: the smoothed label mean of the value over the *other* folds.

    (sum of the value's labels outside the fold + smoothing x mean outside) / (count outside + smoothing);
    a value that only its own fold has gets the mean outside.  No row's label enters its own code.
    """
    rows = train.join(folds, fold_on, "left")
    whole = rows.groupBy("fold").agg(F.sum(label).alias("__fs"), F.count(label).alias("__fn"))
    both = whole.agg(F.sum("__fs").alias("__as"), F.sum("__fn").alias("__an"))
    prior = whole.crossJoin(F.broadcast(both)).select("fold", ((F.col("__as") - F.col("__fs")) / (F.col("__an") - F.col("__fn"))).alias("__prior"))
    out = rows.join(F.broadcast(prior), "fold", "left")  # a row a fold
    for c in cols:
        per = rows.groupBy(F.col(c).alias("__v"), "fold").agg(F.sum(label).alias("__s"), F.count(label).alias("__n"))
        total = per.groupBy("__v").agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
        own = per.join(total, "__v").select("__v", F.col("fold").alias("__f"), (F.col("__ts") - F.col("__s")).alias("__os"), (F.col("__tn") - F.col("__n")).alias("__on"))
        out = out.join(own, (F.col(c) == F.col("__v")) & (F.col("fold") == F.col("__f")), "left")
        out = out.withColumn(f"{c}__te", (F.coalesce("__os", F.lit(0.0)) + smoothing * F.col("__prior")) / (F.coalesce("__on", F.lit(0)) + smoothing)).drop("__v", "__f", "__os", "__on")
    return out.drop("__prior")


ROWS_PER_BUCKET = 200_000  # of the permutation, in one window


def ordered_target_statistics(train: DataFrame, cols: Sequence[str], label: str, key: str = "row_key", prior_weight: float = 1.0, seed: int = 42, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``<c>__te`` for training rows: the smoothed label mean over the rows of the same category that come *before* the row
    in a seeded permutation, (sum + weight x mean of all labels) / (count + weight).

    The permutation is the order of ``md5(seed|key)``.  It is cut into buckets by the hash itself; a window
    runs over one category inside one bucket, and the sums of the buckets before come from a table of a row a
    category and bucket, so a category of any size is spread over tasks.  No row's label enters its own code
    but through the overall mean; ``key`` tells rows apart.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean")).first()
    buckets = max(1, -(-stats["n"] // rows_per_bucket))
    unit = F.conv(F.substring("__order", 1, 8), 16, 10).cast("double") / float(16**8)
    mean = float(stats["mean"] or 0.0)
    # all columns in one long table: a window, a join and an aggregate for any number of them
    entry = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    rows = train.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("y"), h.alias("__order"), F.explode(entry).alias("e"))
    rows = rows.select("__key", "y", "__order", F.floor(unit * buckets).cast("int").alias("b"), "e.c", F.col("e.v").isNull().alias("blank"), F.coalesce("e.v", F.lit("")).alias("v"))
    rows = materialize(rows)
    value = ["c", "blank", "v"]
    ahead = Window.partitionBy(*value).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*value, "b").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    before = before.select(*value, "b", *[F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"{x}0") for x in ("s", "n")])
    inside = Window.partitionBy(*value, "b").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"s1": F.coalesce(F.sum("y").over(inside), F.lit(0.0)), "n1": F.count("y").over(inside)}).join(before, [*value, "b"])
    code = (F.col("s0") + F.col("s1") + F.lit(prior_weight * mean)) / (F.col("n0") + F.col("n1") + prior_weight)
    codes = rows.groupBy("__key").agg(*[F.max(F.when(F.col("c") == i, code)).alias(f"{c}__te") for i, c in enumerate(cols)])
    return train.join(codes, F.col(key) == F.col("__key"), "left").drop("__key")


class OrderedDesign:
    """Median-filled numerics, and categoricals as target statistics: ordered ones for the training rows, those of all
    training rows for any other (a value never seen gets the mean).  ``fit`` returns the design for other rows
    and the training rows' own vectors."""

    def __init__(self, cat: Sequence[str], num: Sequence[str], label: str, key: str = "row_key", prior_weight: float = 1.0, seed: int = 42):
        self.cat, self.num, self.label, self.key, self.prior_weight, self.seed = list(cat), list(num), label, key, prior_weight, seed

    def fit(self, train: DataFrame) -> tuple[PipelineModel, DataFrame]:
        numeric = Design([], self.num, one_hot=False, scale=False, output="__numeric").fit(train).stages if self.num else []
        encoder = encode_categoricals(train, self.cat, self.label, self.prior_weight).stages if self.cat else []
        codes = [f"{c}__te" for c in self.cat]
        join = VectorAssembler(inputCols=(["__numeric"] if self.num else []) + codes, outputCol="features", handleInvalid="keep")
        own = ordered_target_statistics(train, self.cat, self.label, self.key, self.prior_weight, self.seed) if self.cat else train
        return PipelineModel(stages=[*numeric, *encoder, join]), PipelineModel(stages=[*numeric, join]).transform(own)


# I2 ---------------------------------------------------------------------------
# Base learner specs (re-aimed from leaf-wise / depth-wise boosted trees and native-categorical trees).
TREE_SPECS = {
    "gbt_deep": {"kind": "gbt", "maxDepth": 6, "maxIter": 60, "stepSize": 0.1, "subsamplingRate": 0.8},
    "gbt_wide": {"kind": "gbt", "maxDepth": 7, "maxIter": 40, "stepSize": 0.1, "subsamplingRate": 0.8, "categories": "ordered"},
    "forest": {"kind": "rf", "maxDepth": 10, "numTrees": 60, "subsamplingRate": 0.8},
}


def make_regressor(spec: Mapping, features: str = "features", label: str = "target", seed: int = 42, max_bins: int = 512, early_stop: bool = True):
    params = {k: v for k, v in spec.items() if k not in ("kind", "categories")}
    if spec["kind"] == "gbt":
        if early_stop:
            params["validationIndicatorCol"] = "__is_valid"
        return GBTRegressor(featuresCol=features, labelCol=label, seed=seed, maxBins=max_bins, **params)
    return RandomForestRegressor(featuresCol=features, labelCol=label, seed=seed, maxBins=max_bins, **params)


def tree_design(cat: Sequence[str], num: Sequence[str]) -> Design:
    """Trees take indexed categoricals (no one-hot, no scaling)."""
    return design_pipeline(cat, num, one_hot=False, scale=False)


ROWS_PER_TASK = 25_000  # at least: a pass of a tree learner sends every task's bins of every node over the network


@dataclass
class Prepared:
    """A fitted design and the stored vectors (features, label, ``__is_valid``) that learners are fitted on."""

    design: PipelineModel
    data: DataFrame


def prepare(train: DataFrame, valid: DataFrame | None, cat, num, spec: Mapping, label: str = "target", seed: int = 42) -> Prepared:
    """The design is fitted on train and only transforms ``valid`` (medians, category indexes and target statistics never
    see it).  Vectors are computed once, however many passes a learner makes."""
    if spec.get("categories") == "ordered":
        design, rows = OrderedDesign(cat, num, label, seed=seed).fit(train)
    else:
        design = tree_design(cat, num).fit(train)
        rows = design.transform(train)
    data = rows.select("features", label, F.lit(False).alias("__is_valid"))
    if valid is not None:
        data = data.unionByName(design.transform(valid).select("features", label, F.lit(True).alias("__is_valid")))
    data = materialize(data)
    return Prepared(design, data.coalesce(max(1, data.count() // ROWS_PER_TASK)))


# train -> {what the design depends on: (lock, valid, the Prepared rows)}; it lives as long as the train DataFrame
_PREPARED: WeakKeyDictionary = WeakKeyDictionary()
_PREPARING = Lock()


def _prepared(train: DataFrame, valid: DataFrame | None, cat, num, spec: Mapping, label: str, seed: int) -> Prepared:
    """:func:`prepare`, once for all fits on the same two DataFrames that take categoricals alike."""
    key = (id(valid), tuple(cat), tuple(num), spec.get("categories"), label, seed)
    with _PREPARING:
        entry = _PREPARED.setdefault(train, {}).setdefault(key, {"lock": Lock(), "valid": valid, "made": None})
    with entry["lock"]:
        if entry["made"] is None:
            entry["made"] = prepare(train, valid, cat, num, spec, label, seed)
        return entry["made"]


def fit_model(train: DataFrame, valid: DataFrame | None, cat, num, spec: Mapping, label: str = "target", seed: int = 42) -> PipelineModel:
    """Design and regressor, both fitted on train; GBTs early-stop on ``valid``.  A spec with
    ``categories="ordered"`` takes categoricals as ordered target statistics, else as indexes.
    Fits on the same DataFrames share their design and vectors."""
    early = valid is not None and spec["kind"] == "gbt"
    ready = _prepared(train, valid, cat, num, spec, label, seed)
    data = ready.data if early else ready.data.where("not __is_valid")
    reg = make_regressor(spec, label=label, seed=seed, early_stop=early).fit(data)
    return PipelineModel(stages=[*ready.design.stages, reg])


PARALLEL_FITS = 4  # independent fits submitted at a time; Spark shares its cores among their jobs


def _fit_all(fit: Callable, jobs: Sequence) -> list:
    """``fit(job)`` of every job, in order."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(fit, jobs))


def train_tree_models(train: DataFrame, valid: DataFrame, cat, num, specs: Mapping[str, Mapping] = TREE_SPECS, label: str = "target", skip_failed: bool = False):
    """Fit every spec.  Returns (models, failures).  A failing model is an error that names every one of them, once all
    fits have ended; a caller that reports ``failures`` itself may ask to ``skip_failed``."""

    def fit(name: str):
        try:
            return fit_model(train, valid, cat, num, specs[name], label), None
        except Exception as exc:  # noqa: BLE001  the other fits go on
            return None, exc

    done = dict(zip(specs, _fit_all(fit, list(specs)), strict=True))
    failed = {name: exc for name, (_, exc) in done.items() if exc is not None}
    failures = {name: str(exc)[:500] for name, exc in failed.items()}
    if failed and not skip_failed:
        raise RuntimeError(f"{len(failed)} of {len(done)} models failed: {failures}") from next(iter(failed.values()))
    return {name: m for name, (m, _) in done.items() if m is not None}, failures


def predict(models: Mapping[str, PipelineModel], df: DataFrame) -> DataFrame:
    """Add ``pred_<name>`` for every model (each transform adds and drops its scratch columns)."""
    out = df
    for name, m in models.items():
        out = drop_scratch(m.transform(out).withColumnRenamed("prediction", f"pred_{name}"))
    return out


MEAN_ENSEMBLE = "pred_ensemble_mean"


def add_mean_ensemble(df: DataFrame, preds: Sequence[str]) -> DataFrame:
    """The plain mean of the trees' predictions, if there are at least two."""
    return df.withColumn(MEAN_ENSEMBLE, sum((F.col(p) for p in preds), F.lit(0.0)) / len(preds)) if len(preds) >= 2 else df


# I3 ---------------------------------------------------------------------------
def tune(train: DataFrame, valid: DataFrame, cat, num, space: Mapping[str, tuple], n_trials: int = 10, seed: int = 42, base: Mapping | None = None, label: str = "target"):
    """Seeded random search (log-uniform for ``("log", lo, hi)``, uniform ints for ``("int", lo, hi)``)
    minimising validation RMSE.  Returns (best params, trials DataFrame)."""
    from fairlease.operators.stats import regression_metrics

    rng = random.Random(seed)
    base = dict(base or {"kind": "gbt"})
    drawn = []
    for _ in range(n_trials):
        params = dict(base)
        for k, (kind, lo, hi) in space.items():
            params[k] = int(rng.randint(lo, hi)) if kind == "int" else float(10 ** rng.uniform(__import__("math").log10(lo), __import__("math").log10(hi)))
        drawn.append(params)

    def run(job: tuple[int, dict]) -> dict:
        t, params = job
        model = fit_model(train, valid, cat, num, params, label)
        m = regression_metrics(model.transform(valid), label, ["prediction"]).first()
        return {"trial": t, "params": json.dumps(params, sort_keys=True), "rmse": float(m["rmse"]), "mae": float(m["mae"]), "r2": float(m["r2"])}

    trials = _fit_all(run, list(enumerate(drawn)))
    best = min(trials, key=lambda r: (r["rmse"], r["trial"]))
    return json.loads(best["params"]), train.sparkSession.createDataFrame(trials)


# I4 ---------------------------------------------------------------------------
@dataclass
class OutOfFold:
    """``predictions``: (key, fold, model, target, oof) of the fits that worked.  ``outcomes``: a row a (fold, model) with its
    error (NULL where it worked)."""

    predictions: DataFrame
    outcomes: DataFrame
    key: str
    label: str

    def complete_models(self) -> DataFrame:
        """(model): those that have a prediction for every training row, i.e. whose every fold worked."""
        failed = self.outcomes.where("error is not null").select("model").distinct()
        return self.outcomes.select("model").distinct().join(failed, "model", "left_anti")

    def complete(self) -> DataFrame:
        """The predictions of the complete models alone; no such model is an error."""
        kept = self.predictions.join(F.broadcast(self.complete_models()), "model", "left_semi")
        if kept.isEmpty():
            raise RuntimeError("no model has out-of-fold predictions for every row")
        return kept

    def fold_metrics(self) -> DataFrame:
        """(fold, model, n, rmse, mae, r2, error): a row a fold and model, with the metrics of the fits that worked."""
        e, y = F.col(self.label) - F.col("oof"), F.col(self.label)
        sums = self.predictions.groupBy("fold", "model").agg(
            F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2")
        )
        return self.outcomes.join(sums, ["fold", "model"], "left").select("fold", "model", "n", "rmse", "mae", "r2", "error")


def out_of_fold(train: DataFrame, folds: DataFrame, cat, num, specs: Mapping[str, Mapping], key: str = "row_key", label: str = "target", fold_on: str = "ym") -> OutOfFold:
    """For each fold, fit every spec on the other folds and predict the fold.  A fit that fails costs its own
    (fold, model) and is recorded; predictions are stored as they come, so a late failure loses nothing."""
    data = materialize(train.join(F.broadcast(folds), fold_on, "left"))
    n_folds = folds.agg(F.max("fold")).first()[0] + 1
    others = [data.filter(F.col("fold") != fold) for fold in range(n_folds)]

    def fit(job: tuple[int, str]):
        fold, name = job
        try:
            m = fit_model(others[fold], None, cat, num, specs[name], label)
            hold = m.transform(data.filter(F.col("fold") == fold))
            return materialize(hold.select(key, "fold", F.lit(name).alias("model"), label, F.col("prediction").alias("oof"))), None
        except Exception as exc:  # noqa: BLE001  reported in the outcomes, not fatal
            return None, str(exc)[:500]

    jobs = [(i, name) for i in range(n_folds) for name in specs]
    done = _fit_all(fit, jobs)
    parts = [p for p, _ in done if p is not None]
    spark = train.sparkSession
    outcomes = spark.createDataFrame([(i, name, error) for (i, name), (_, error) in zip(jobs, done, strict=True)], "fold long, model string, error string")
    out = data.select(key, "fold", F.lit("").alias("model"), label, F.lit(0.0).alias("oof")).where(F.lit(False))
    for p in parts:
        out = out.unionByName(p)
    return OutOfFold(out, outcomes, key, label)


def oof_predictions(train: DataFrame, folds: DataFrame, cat, num, specs: Mapping[str, Mapping], key: str = "row_key", label: str = "target") -> DataFrame:
    """(key, fold, model, oof) of the models that have a prediction for every row."""
    return out_of_fold(train, folds, cat, num, specs, key, label).complete().select(key, "fold", "model", "oof")


# I5 ---------------------------------------------------------------------------
def holdout_predictions(train: DataFrame, holdout: DataFrame, cat, num, specs: Mapping[str, Mapping], context: Sequence[str] = (), key: str = "row_key", label: str = "target") -> DataFrame:
    """Fit once on train (early stopping off the holdout), predict the holdout with context columns."""
    models = dict(zip(specs, _fit_all(lambda spec: fit_model(train, None, cat, num, spec, label), list(specs.values())), strict=True))
    return predict(models, holdout).select(key, *[c for c in context if c in holdout.columns], label, *[f"pred_{n}" for n in models])


# I11 --------------------------------------------------------------------------
def save_model(model: PipelineModel, path: str, metadata: Mapping) -> None:
    """Spark ML persistence for the model, plus the JSON metadata beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "metadata string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    return PipelineModel.load(f"{path}/model"), meta
