"""Prediction alignment and ensembles.

Fitting reduces the data to sufficient statistics in one aggregate (means and a
k x k Gram matrix, k = number of base models <= ~6); only those numbers reach
the driver, where a tiny solve runs.  Applying a fitted ensemble is a column
expression with literal weights, so scoring stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlease.functions.columns import nan_to_null
from fairlease.session import materialize

RIDGE_ALPHAS = tuple(np.logspace(-4, 4, 25).tolist())
PRED_PREFIX = "pred_"


# B22 --------------------------------------------------------------------------
def prediction_suffix(col: str) -> str:
    if col.startswith("pred_"):
        return col[len("pred_"):]
    if col.endswith("_pred"):
        return col[: -len("_pred")]
    return col


def prediction_columns(df: DataFrame) -> list[str]:
    """Prediction columns by naming convention (``pred_*`` or ``*_pred``), in schema order."""
    return [c for c in df.columns if c.startswith("pred_") or c.endswith("_pred")]


def select_predictions(df: DataFrame, names: Sequence[str], key: str = "row_key", target: str = "target") -> DataFrame:
    """Key, target and the named predictions as canonical ``pred_<name>`` columns; unknown names raise."""
    by_suffix = {prediction_suffix(c): c for c in prediction_columns(df)}
    missing = [n for n in names if n not in by_suffix]
    if missing:
        raise ValueError(f"prediction columns not found: {missing}; available: {sorted(by_suffix)}")
    return df.select(key, target, *[F.col(by_suffix[n]).alias(f"{PRED_PREFIX}{n}") for n in names])


def run_name(names: Sequence[str]) -> str:
    """The run that combines these predictions: their canonical names joined by two underscores."""
    return "__".join(prediction_suffix(n) for n in names)


# D8 ---------------------------------------------------------------------------
def align_predictions(frames: Mapping[str, DataFrame], key: str = "row_key", target: str = "target", atol: float = 1e-9) -> DataFrame:
    """Prediction sets side by side on ``key``; every set must cover the same keys, each once, with the same target
    (NULL where the others have NULL).

    Duplicate prediction names get the source name as suffix.  All sets meet in one aggregate over
    their stacked rows, whose result is a stage boundary; one more aggregate over it makes all checks.
    """
    names, seen, stacked, preds = list(frames), set(), [], []
    for i, name in enumerate(names):
        cols = []
        for c in prediction_columns(frames[name]):
            s = prediction_suffix(c)
            new = f"{PRED_PREFIX}{s}" if s not in seen else f"{PRED_PREFIX}{s}_{name}"
            if not i:
                new = c  # the first set keeps its names
            seen.add(prediction_suffix(new))
            cols.append(F.col(c).alias(new))
            preds.append(new)
        stacked.append(frames[name].select(F.col(key), F.col(target).alias("__t"), F.lit(i).alias("__set"), *cols))
    rows = stacked[0]
    for more in stacked[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    own = lambda i, e: F.when(F.col("__set") == i, e)
    per_set = [x for i in range(len(names)) for x in (F.count(own(i, F.lit(1))).alias(f"__n{i}"), F.max(own(i, nan_to_null("__t"))).alias(f"__t{i}"))]
    joined = materialize(rows.groupBy(key).agg(*per_set, F.max(own(0, F.col("__t"))).alias(target), *[F.max(p).alias(p) for p in preds]))
    checks = []
    for i in range(len(names)):
        differ = ~F.coalesce(F.abs(F.col(f"__t{i}") - F.col("__t0")) <= atol, F.col(f"__t{i}").isNull() & F.col("__t0").isNull())
        checks += [F.count_if(F.col(f"__n{i}") != F.greatest(F.lit(1), "__n0")).alias(f"rows{i}"), F.count_if(F.col(f"__n{i}") > 1).alias(f"twice{i}"), F.count_if(differ).alias(f"differ{i}")]
    found = joined.agg(*checks).first()
    for i, name in enumerate(names):
        if found[f"twice{i}"]:
            raise ValueError(f"prediction set {name!r} has {found[f'twice{i}']} keys more than once")
    for i, name in enumerate(names):
        if found[f"rows{i}"]:
            raise ValueError(f"prediction set {name!r} does not cover the same rows ({found[f'rows{i}']} keys differ)")
        if found[f"differ{i}"]:
            raise ValueError(f"prediction set {name!r} has a different target in {found[f'differ{i}']} rows")
    return joined.select(key, target, *preds)


# I8 ---------------------------------------------------------------------------
def weighted_prediction(preds: Sequence[str], weights: Sequence[float]) -> Column:
    """Σ w_i · pred_i with weights clipped at 0 and normalised (all zero -> equal)."""
    w = np.clip(np.asarray(weights, dtype=float), 0.0, None)
    w = np.ones(len(preds)) / len(preds) if w.sum() == 0 else w / w.sum()
    return sum((F.col(p) * F.lit(float(wi)) for p, wi in zip(preds, w)), F.lit(0.0))


def ensemble_equal(preds: Sequence[str]) -> Column:
    return weighted_prediction(preds, [1.0] * len(preds))


# sufficient statistics --------------------------------------------------------
def _moments(df: DataFrame, xs: Sequence[str], y: str):
    """n, means, centred X'X and X'y, y'y (centred), from one aggregate."""
    k = len(xs)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my")] + [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(F.col(x) * F.col(y)).alias(f"sy{i}") for i, x in enumerate(xs)] + [F.sum(F.col(y) * F.col(y)).alias("syy")]
    r = df.select(*xs, y).dropna().agg(*aggs).first().asDict()
    n = int(r["n"])
    if n == 0:
        raise ValueError("no complete rows to fit on")
    m = np.array([r[f"m{i}"] for i in range(k)])
    my = r["my"]
    xx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = r[f"s{i}_{j}"] - n * m[i] * m[j]
    xy = np.array([r[f"sy{i}"] - n * m[i] * my for i in range(k)])
    yy = r["syy"] - n * my * my
    return n, m, my, xx, xy, yy


# I9 ---------------------------------------------------------------------------
def fit_simplex_weights(df: DataFrame, preds: Sequence[str], y: str = "target", iters: int = 5000) -> dict[str, float]:
    """Weights on the simplex minimising RMSE of Σ w_i pred_i (equal weights if the solve fails).

    MSE(w) = w'Gw - 2b'w + c with G = E[x x'], b = E[x y]: one aggregate gives G and b,
    then projected gradient descent on the k-simplex runs on the driver.
    """
    k = len(preds)
    if k == 1:
        return {preds[0]: 1.0}
    aggs = [F.avg(F.col(preds[i]) * F.col(preds[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.avg(F.col(p) * F.col(y)).alias(f"b{i}") for i, p in enumerate(preds)]
    r = df.select(*preds, y).dropna().agg(*aggs).first().asDict()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"]
    b = np.array([r[f"b{i}"] for i in range(k)])
    w = np.ones(k) / k
    try:
        step = 1.0 / max(np.linalg.eigvalsh(2 * g).max(), 1e-12)
        for _ in range(iters):
            w_new = _project_simplex(w - step * (2 * g @ w - 2 * b))
            if np.abs(w_new - w).max() < 1e-13:
                w = w_new
                break
            w = w_new
    except np.linalg.LinAlgError:
        w = np.ones(k) / k
    if not np.all(np.isfinite(w)):
        w = np.ones(k) / k
    w = np.clip(w, 0, None)
    w = w / w.sum() if w.sum() > 0 else np.ones(k) / k
    return dict(zip(preds, w.tolist()))


def _project_simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection onto {w >= 0, Σw = 1} (sort-based)."""
    u = np.sort(v)[::-1]
    css = np.cumsum(u)
    rho = np.nonzero(u * np.arange(1, len(v) + 1) > (css - 1))[0][-1]
    theta = (css[rho] - 1) / (rho + 1.0)
    return np.maximum(v - theta, 0)


# I6 ---------------------------------------------------------------------------
class RidgeStack:
    """Ridge meta-model with intercept; alpha chosen from ``alphas`` by exact leave-one-out error.

    Fit = one aggregate for the centred Gram matrix + a k x k eigendecomposition on
    the driver + one aggregate that sums, for every alpha at once, the squared LOO
    residuals e_i / (1 - h_ii) with h_ii = 1/n + x̃_i' (X̃'X̃ + αI)^-1 x̃_i.
    """

    def __init__(self, alphas: Sequence[float] = RIDGE_ALPHAS):
        self.alphas = list(alphas)
        self.alpha_: float | None = None
        self.coef_: np.ndarray | None = None
        self.intercept_: float | None = None
        self.features: list[str] = []

    def fit(self, df: DataFrame, preds: Sequence[str], y: str = "target") -> "RidgeStack":
        xs = list(preds)
        self.features = xs
        n, m, my, xx, xy, _ = _moments(df, xs, y)
        k = len(xs)
        errs = []
        cols = [(nan_to_null(x) - float(mi)) for x, mi in zip(xs, m)]
        yc = nan_to_null(y) - float(my)
        for a in self.alphas:
            inv = np.linalg.inv(xx + a * np.eye(k))
            beta = inv @ xy
            fit = sum((c * float(bj) for c, bj in zip(cols, beta)), F.lit(0.0))
            h = F.lit(1.0 / n) + sum((cols[i] * cols[j] * float(inv[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
            errs.append(F.sum(F.pow((yc - fit) / (1 - h), 2)).alias(f"e{len(errs)}"))
        row = df.select(*xs, y).dropna().agg(*errs).first()
        best = int(np.argmin([row[i] for i in range(len(self.alphas))]))
        self.alpha_ = float(self.alphas[best])
        self.coef_ = np.linalg.inv(xx + self.alpha_ * np.eye(k)) @ xy
        self.intercept_ = float(my - m @ self.coef_)
        return self

    def expression(self, preds: Sequence[str] | None = None) -> Column:
        preds = list(preds or self.features)
        return sum((F.col(p) * float(c) for p, c in zip(preds, self.coef_)), F.lit(self.intercept_))

    def transform(self, df: DataFrame, out: str = "stacking_pred", target: str | None = "target") -> DataFrame:
        df = df.withColumn(out, self.expression())
        if target and target in df.columns:
            df = df.withColumn(out.replace("_pred", "_residual"), F.col(target) - F.col(out))
        return df

    def report(self) -> dict:
        return {"model": "ridge_loo", "alpha": self.alpha_, "intercept": self.intercept_, "coef": dict(zip(self.features, self.coef_.tolist()))}


# I7 ---------------------------------------------------------------------------
def stack_saved(valid: DataFrame, test: DataFrame, preds: Sequence[str], target: str = "target") -> tuple[DataFrame, dict]:
    """Fit the ridge stack on the validation predictions, score the test predictions."""
    model = RidgeStack().fit(valid, preds, target)
    return model.transform(test, "stacking_pred", target), model.report()


# I10 / I12 --------------------------------------------------------------------
def add_ensembles(df: DataFrame, preds: Sequence[str], weights: Mapping[str, float], target: str = "target") -> DataFrame:
    """Equal and weighted ensemble columns plus their residuals."""
    out = df.withColumns(
        {"pred_ensemble_equal": ensemble_equal(preds), "pred_ensemble_weighted": weighted_prediction(preds, [weights[p] for p in preds])}
    )
    return out.withColumns(
        {
            "residual_ensemble_equal": F.col(target) - F.col("pred_ensemble_equal"),
            "residual_ensemble_weighted": F.col(target) - F.col("pred_ensemble_weighted"),
        }
    )


def ensemble_report(df: DataFrame, preds: Sequence[str], target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Long metrics per model on the log scale (rmse, mae, r2) and the ratio scale (after expm1)."""
    from fairlease.operators.stats import regression_metrics

    cols = list(preds) + [c for c in ("pred_ensemble_equal", "pred_ensemble_weighted") if c in df.columns]
    log = regression_metrics(df, target, cols, by).withColumn("scale", F.lit("log"))
    ratio_df = df.select(*by, F.expm1(target).alias(target), *[F.expm1(c).alias(c) for c in cols])
    ratio = regression_metrics(ratio_df, target, cols, by).withColumn("scale", F.lit("ratio"))
    return log.unionByName(ratio)


def prediction_output(df: DataFrame, context: Sequence[str], target: str, preds: Mapping[str, Column]) -> DataFrame:
    """Context columns + target + ``pred_<name>`` + ``residual_<name>``."""
    cols = [c for c in context if c in df.columns]
    out = df.select(*cols, F.col(target).alias("target"), *[v.alias(f"pred_{k}") for k, v in preds.items()])
    return out.withColumns({f"residual_{k}": F.col("target") - F.col(f"pred_{k}") for k in preds})
