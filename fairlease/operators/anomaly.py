"""Unsupervised / anomaly operators.

* k-means: all seeded restarts in one pass an iteration over weighted distinct points, best cost kept.
* distances, robust z, merges: array expressions against the k centroids (a
  bounded, broadcast-sized set: k <= a few dozen vectors).
* isolation forest (Liu, Ting & Zhou 2008): trees are grown on bounded
  per-tree samples with ``groupBy("tree").applyInPandas`` (≈ψ rows per group),
  the node table (T x <2ψ rows) is broadcast, and rows are scored by a
  vectorised ``mapInPandas`` traversal — the fact table is never collected.
* LOF (J6) lives in :mod:`fairlease.operators.lof` (exact k-nearest neighbours by
  projected radius search over weighted distinct points).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlease.functions.columns import log1p_clipped, nan_to_null
from fairlease.operators.quantiles import _null_safe_join, global_percentiles, group_percentiles
from fairlease.session import materialize

# Fixed values (robust z and cluster rules).
MAD_SCALE = 1.4826
EPS = 1e-9
MIN_CLUSTER_SIZE = 30
MIN_MAD = 1e-3
MIN_CLUSTER_ROWS = 500
IFOREST_TREES = 300
IFOREST_SAMPLE = 256
CONTAMINATION = 0.02


# J12 --------------------------------------------------------------------------
def unsupervised_frame(df: DataFrame) -> DataFrame:
    """Property type, clean area and rooms, and log lease median (clipped at 0)."""
    return df.withColumn("rent_deposit_median_log", log1p_clipped(nan_to_null("rent_deposit_median")))


UNSUP_CAT = ("property_type",)
UNSUP_NUM = ("area_m2_clean", "room_count_clean", "rent_deposit_median_log")


# J1 ---------------------------------------------------------------------------
class KMeansFit:
    """Centres of the best restart; ``transform`` adds the index of the nearest one."""

    def __init__(self, centers: np.ndarray, cost: float, costs: list[float], features: str, out: str = "cluster"):
        self.centers, self.cost, self.costs, self.features, self.out = centers, cost, costs, features, out

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  as Spark's model names it
        return list(self.centers)

    def transform(self, df: DataFrame) -> DataFrame:
        held = {c: F.col(c) for c in df.columns if c not in (self.out, "__distance")}
        return centroid_distance(df, self.centers.tolist(), self.features, None, "__distance").select(*held.values(), F.col("cluster").alias(self.out))


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit ids and salts, the same in every run."""
    x = ids.astype(np.uint64)
    for k in salt:
        x = (x ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to ``centers`` (restart, cluster, axis), clipped at 0."""
    flat = centers.reshape(-1, centers.shape[-1])
    d = (x * x).sum(1)[:, None] - 2 * x @ flat.T + (flat * flat).sum(1)[None, :]
    return np.maximum(d, 0).reshape(len(x), *centers.shape[:2])


def _over_points(points: DataFrame, make, schema: str, width: int) -> DataFrame:
    """``make(id, x, w)`` of the points (id, x, w), as many at a time as keep ``width`` distances each within 16 MB."""

    def run(batches):
        step = max(1, (1 << 21) // width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                yield from make(np.asarray(part.column(0)), x, np.asarray(part.column(2), float))

    return points.mapInArrow(run, schema)


def _sums(points: DataFrame, centers: np.ndarray) -> np.ndarray:
    """(restart, cluster, axis + 2): per nearest centre the weighted sum of its points, their weight and cost; one job."""
    import pyarrow as pa

    restarts, k, dim = centers.shape

    def make(_, x, w):
        d = _squares(x, centers)
        near = d.argmin(2)
        rows = np.zeros((restarts, k, dim + 2))
        for r in range(restarts):
            who = near[:, r]
            for axis in range(dim):
                rows[r, :, axis] = np.bincount(who, w * x[:, axis], k)
            rows[r, :, dim] = np.bincount(who, w, k)
            rows[r, :, dim + 1] = np.bincount(who, w * d[np.arange(len(x)), r, who], k)
        slot = np.arange(restarts * k)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(list(rows.reshape(restarts * k, -1)), pa.list_(pa.float64()))], names=["slot", "sums"])

    partial = _over_points(points, make, "slot int, sums array<double>", restarts * k)
    out = np.zeros((restarts * k, dim + 2))
    for r in partial.groupBy("slot").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim + 2)]).collect():  # restarts x k rows
        out[r["slot"]] = [r[f"s{i}"] for i in range(dim + 2)]
    return out.reshape(restarts, k, dim + 2)


POINTS_PER_TASK = 20_000  # at least, in a pass of k-means


def _seed_centers(points: DataFrame, k: int, restarts: int, seed: int, rounds: int = 2) -> np.ndarray:
    """k-means|| for all restarts at once: a job for the cost and one for the draw a round, one for the candidates'
    weights, then k-means++ over the few dozen weighted candidates of each restart on the driver."""
    import pyarrow as pa

    first = points.orderBy(F.xxhash64("id", F.lit(seed))).limit(restarts).select("x").collect()  # at most ``restarts`` rows
    candidates = [[np.array(first[r % len(first)]["x"], float)] for r in range(restarts)]

    def padded() -> np.ndarray:
        most = max(map(len, candidates))
        return np.array([c + [c[0]] * (most - len(c)) for c in candidates])

    for turn in range(rounds):
        held = padded()
        cost = _sums(points, held)[:, :, -1].sum(1)

        def draw(ids, x, w, held=held, cost=cost, turn=turn):
            d = _squares(x, held).min(2)
            for r in range(restarts):
                if cost[r] > 0:
                    hit = np.flatnonzero(_uniform(ids, seed, r, turn) < 2.0 * k * w * d[:, r] / cost[r])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), r), pa.int32()), pa.array(list(x[hit]), pa.list_(pa.float64()))], names=["restart", "x"])

        for row in _over_points(points, draw, "restart int, x array<double>", held.shape[0] * held.shape[1]).orderBy("restart", "x").collect():  # about 2 k a restart and round
            candidates[row["restart"]].append(np.array(row["x"], float))
    weights = _sums(points, padded())[:, :, -2]
    out = []
    for r in range(restarts):
        x, w = np.array(candidates[r]), weights[r][: len(candidates[r])]
        rng = np.random.default_rng([seed, r])
        chosen = [int(rng.choice(len(x), p=w / w.sum()))]
        while len(chosen) < k:
            d = _squares(x, x[None, chosen])[:, 0].min(1) * w
            chosen.append(int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else chosen[0])
        out.append(x[chosen])
    return np.array(out)


def fit_kmeans(df: DataFrame, k: int, restarts: int = 20, seed: int = 42, features: str = "features", max_iter: int = 50, tol: float = 1e-4) -> KMeansFit:
    """Best of ``restarts`` seeded k-means fits (lowest training cost), all of them in one pass an iteration.

    Equal vectors become one weighted point, stored once.  An iteration is one job: tasks add up their
    points for every (restart, cluster), Spark adds the partial sums, and the driver sees restarts x k
    rows.  A restart stops when no centre has moved by more than ``tol``.  NULL vectors take no part;
    with fewer distinct vectors than ``k`` some centres coincide.
    """
    arr = vector_to_array(F.col(features)) if dict(df.dtypes).get(features) == "vector" else F.col(features).cast("array<double>")
    points = df.select(arr.alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w"))
    points = materialize(points.select(F.xxhash64("x").alias("id"), "x", "w"))
    if points.isEmpty():
        raise ValueError("k-means needs at least one row")
    tasks = min(points.count() // POINTS_PER_TASK, points.sparkSession.sparkContext.defaultParallelism)
    if tasks > points.rdd.getNumPartitions():  # a pass is one job, so its tasks are the rows' files
        points = materialize(points.repartition(tasks))
    centers = _seed_centers(points, k, restarts, seed)
    live, costs = np.arange(restarts), np.full(restarts, np.inf)
    for _ in range(max_iter):
        sums = _sums(points, centers[live])
        costs[live] = sums[:, :, -1].sum(1)
        n = sums[:, :, -2:-1]
        moved = np.where(n > 0, sums[:, :, :-2] / np.maximum(n, 1), centers[live])
        far = np.sqrt(np.square(moved - centers[live]).sum(2)).max(1) > tol
        centers[live] = moved
        live = live[far]
        if not len(live):
            break
    costs = _sums(points, centers)[:, :, -1].sum(1)
    best = int(costs.argmin())
    return KMeansFit(centers[best], float(costs[best]), costs.tolist(), features)


def centroid_array(centers) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])


def _dist(arr: Column, centre: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(arr, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))


def _nearest(centers):
    """Column function: an array's distance to its nearest centroid and that one's index, computed batch by batch.

    A NULL array, one with a NULL in it or one of another length has no distance and the index 0, as NaN has."""
    import pyarrow as pa

    cents = np.asarray(centers, float)
    kind = pa.struct([("d", pa.float64()), ("i", pa.int32())])

    @F.arrow_udf("d double, i int")
    def nearest(arrays):
        n, (k, dim) = len(arrays), cents.shape
        known = np.asarray(arrays.is_valid()) & (np.asarray(arrays.value_lengths().fill_null(-1)) == dim)
        x = arrays.filter(pa.array(known)).flatten()
        if x.null_count:
            whole = np.asarray(x.is_valid()).reshape(-1, dim).all(1)
            x, known[known] = x.filter(pa.array(np.repeat(whole, dim))), whole
        x = np.asarray(x, dtype=float).reshape(-1, dim)
        far = np.zeros((len(x), k))
        for axis in range(dim):  # an axis at a time: the order in which a row would add them up
            gap = x[:, axis, None] - cents[None, :, axis]
            far += gap * gap
        best = np.where(np.isnan(far), np.inf, far).argmin(1)
        d, i = np.zeros(n), np.zeros(n, np.int32)
        d[known], i[known] = np.sqrt(far[np.arange(len(x)), best]), best
        return pa.StructArray.from_arrays([pa.array(d, mask=~known), pa.array(i)], fields=list(kind))

    return nearest


# J2 ---------------------------------------------------------------------------
def centroid_distance(df: DataFrame, centers, vec: str, cluster: str | None = None, out: str = "kmeans_distance") -> DataFrame:
    """Euclidean distance to the assigned centroid (``cluster`` column) or, without one, the nearest
    centroid and its index.  Centroids travel with the expression (k x d numbers)."""
    arr = (vector_to_array(F.col(vec)) if dict(df.dtypes).get(vec) != "array<double>" else F.col(vec)).cast("array<double>")
    if cluster is not None:
        return df.withColumn(out, _dist(arr, F.element_at(centroid_array(centers), F.col(cluster).cast("int") + 1)))
    return df.withColumn("__best", _nearest(centers)(arr)).withColumns({out: F.col("__best.d"), "cluster": F.col("__best.i")}).drop("__best")


# J3 ---------------------------------------------------------------------------
def robust_z(
    df: DataFrame, cluster: str, dist: str, fit_on: Column | None = None, min_rows: int = MIN_CLUSTER_SIZE, min_mad: float = MIN_MAD, out: str = "kmeans_robust_z"
) -> tuple[DataFrame, DataFrame]:
    """(d - median) / (1.4826·MAD + 1e-9) per cluster, fitted on ``fit_on`` rows; small clusters
    (< min_rows) and clusters with MAD < min_mad use the global median / MAD.  Returns (rows, stats)."""
    fit = df if fit_on is None else df.filter(fit_on)
    g = global_percentiles(fit.select(dist), [("gmed", dist, 0.5)])
    gdev = fit.select(dist).crossJoin(F.broadcast(g)).select(F.abs(F.col(dist) - F.col("gmed")).alias("__ad"))
    gmad = global_percentiles(gdev, [("gmad", "__ad", 0.5)])
    gstats = g.crossJoin(gmad).select("gmed", F.greatest(F.col("gmad"), F.lit(min_mad)).alias("gmad"))
    med = group_percentiles(fit, [cluster], [("cmed", dist, 0.5)])
    dev = _null_safe_join(fit.select(cluster, dist), med, [cluster]).select(cluster, F.abs(F.col(dist) - F.col("cmed")).alias("__ad"))
    mad = group_percentiles(dev, [cluster], [("cmad", "__ad", 0.5)])
    cnt = fit.groupBy(cluster).agg(F.count(F.lit(1)).alias("train_rows"))
    st = _null_safe_join(_null_safe_join(cnt, med, [cluster]), mad, [cluster]).crossJoin(F.broadcast(gstats))
    fallback = (F.col("train_rows") < min_rows) | (F.col("cmad") < min_mad)
    st = st.select(
        cluster, "train_rows", fallback.alias("used_global_fallback"),
        F.when(fallback, F.col("gmed")).otherwise(F.col("cmed")).alias("distance_median"),
        F.when(fallback, F.col("gmad")).otherwise(F.col("cmad")).alias("distance_mad"),
    )
    # clusters seen only outside the fit rows fall back to the global stats
    j = _null_safe_join(df, st.select(cluster, "distance_median", "distance_mad"), [cluster]).crossJoin(F.broadcast(gstats))
    m = F.coalesce(F.col("distance_median"), F.col("gmed"))
    s = F.coalesce(F.col("distance_mad"), F.col("gmad"))
    rows = j.withColumn(out, (F.col(dist) - m) / (MAD_SCALE * s + EPS)).drop("distance_median", "distance_mad", "gmed", "gmad")
    return rows, st


# J4 ---------------------------------------------------------------------------
def merge_small_clusters(df: DataFrame, centers, cluster: str = "cluster", min_rows: int = MIN_CLUSTER_ROWS) -> DataFrame:
    """Mapping (raw_cluster, merged_cluster, display_cluster): clusters with < min_rows rows join the
    nearest large centroid; with no large cluster the 3 largest are kept; display ids are 1..n."""
    counts = {int(r[0]): int(r[1]) for r in df.groupBy(cluster).count().collect()}  # k rows
    k = len(centers)
    large = sorted(c for c, n in counts.items() if n >= min_rows)
    if not large:
        large = sorted(sorted(counts, key=lambda c: (-counts[c], c))[: max(1, min(3, len(counts)))])
    cen = np.asarray(centers, dtype=float)
    mapping = {}
    for c in range(k):
        if c in large:
            mapping[c] = c
        else:
            mapping[c] = min(large, key=lambda lg: float(np.linalg.norm(cen[c] - cen[lg])))
    merged = sorted({mapping[c] for c in counts})
    display = {m: i + 1 for i, m in enumerate(merged)}
    rows = [(c, mapping[c], str(display.get(mapping[c], mapping[c] + 1))) for c in range(k)]
    return df.sparkSession.createDataFrame(rows, "raw_cluster int, merged_cluster int, display_cluster string")


# J5 ---------------------------------------------------------------------------
def _c_factor(n):
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649015329) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(pdf: pd.DataFrame, psi: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    sample = pdf.sort_values("u").head(psi)
    x = np.stack(sample["x"].to_numpy()).astype(float) if len(sample) else np.zeros((0, 1))
    rng = np.random.default_rng([seed, tree])
    limit = int(math.ceil(math.log2(max(psi, 2))))
    nodes = []  # node, feature, threshold, left, right, size, depth

    def build(idx, depth):
        nid = len(nodes)
        nodes.append(None)
        pts = x[idx]
        if depth >= limit or len(idx) <= 1:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        lo, hi = pts.min(axis=0), pts.max(axis=0)
        cand = np.nonzero(hi > lo)[0]
        if len(cand) == 0:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        left = build(idx[pts[:, f] < t], depth + 1)
        right = build(idx[pts[:, f] >= t], depth + 1)
        nodes[nid] = (nid, f, t, left, right, len(idx), depth)
        return nid

    build(np.arange(len(x)), 0)
    out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
    out.insert(0, "tree", tree)
    out["n_sample"] = len(x)
    return out


NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size long, depth int, n_sample long"


def _distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``x`` and, for each of its rows, which of them it is."""
    x = np.ascontiguousarray(x)
    if not x.size:
        return x, np.arange(len(x))
    _, first, again = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return x[first], again


class IsolationForestModel:
    def __init__(self, nodes: pd.DataFrame, psi: int, offset: float | None = None):
        self.nodes = nodes
        self.psi = psi
        self.offset = offset

    def _arrays(self):
        trees = sorted(self.nodes["tree"].unique())
        width = int(self.nodes["node"].max()) + 1
        shape = (len(trees), width)
        feat = np.full(shape, -1, dtype=np.int64)
        thr = np.zeros(shape)
        left = np.full(shape, -1, dtype=np.int64)
        right = np.full(shape, -1, dtype=np.int64)
        leaf_len = np.zeros(shape)
        pos = {t: i for i, t in enumerate(trees)}
        r = self.nodes
        ti = r["tree"].map(pos).to_numpy()
        ni = r["node"].to_numpy()
        feat[ti, ni] = r["feature"].to_numpy()
        thr[ti, ni] = r["threshold"].to_numpy()
        left[ti, ni] = r["left"].to_numpy()
        right[ti, ni] = r["right"].to_numpy()
        leaf_len[ti, ni] = r["depth"].to_numpy() + _c_factor(r["size"].to_numpy())
        return feat, thr, left, right, leaf_len

    def score_frame(self, df: DataFrame, vec: str, out: str = "isolation_score", raw: bool = False) -> DataFrame:
        """Anomaly score s = 2^(-E[h(x)]/c(ψ)); with a fitted offset, ``s + offset`` (= -decision_function).

        Only the vector column goes to Python, as Arrow batches; the rows' other columns stay where they are.
        """
        cpsi = float(_c_factor(np.array([self.psi]))[0])
        offset = 0.0 if (raw or self.offset is None) else float(self.offset)
        bc = df.sparkSession.sparkContext.broadcast((*self._arrays(), cpsi, offset))

        @F.pandas_udf("double")
        def score(vectors: pd.Series) -> pd.Series:
            feat, thr, left, right, leaf, c, off = bc.value
            n_trees = feat.shape[0]
            x = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 1))
            x, again = _distinct_rows(x)
            total = np.zeros(len(x))
            rows, flat = np.arange(len(x)), np.ascontiguousarray(x.T).ravel()
            nodes = np.arange(feat.shape[1])
            for t in range(n_trees):
                # a leaf leads to itself on both sides, so all rows go down together
                inner = feat[t] >= 0
                at = np.where(inner, feat[t], 0) * len(x)
                child = np.where(inner, [right[t], left[t]], nodes).T.ravel()
                node = np.zeros(len(x), dtype=np.int64)
                while inner.take(node).any():
                    go_left = flat.take(at.take(node) + rows) < thr[t].take(node)
                    node = child.take(2 * node + go_left)
                total += leaf[t].take(node)
            return pd.Series((np.power(2.0, -(total / max(n_trees, 1)) / c) + off)[again])

        arr = vector_to_array(F.col(vec)) if dict(df.dtypes).get(vec) == "vector" else F.col(vec)
        return df.withColumn(out, score(arr))


def fit_isolation_forest(
    df: DataFrame, vec: str, key: str, n_trees: int = IFOREST_TREES, psi: int = IFOREST_SAMPLE, seed: int = 42,
    contamination: float | None = CONTAMINATION, oversample: float = 1.5,
) -> IsolationForestModel:
    """Grow ``n_trees`` isolation trees on independent ≈ψ-row samples; with ``contamination``, the
    offset is the matching percentile of training scores (so that the score is -decision_function)."""
    n = df.count()
    want = oversample * psi * n_trees
    copies = max(1, math.ceil(want / max(n, 1)))  # small tables: each row serves several trees
    frac = min(1.0, want / (copies * max(n, 1)))
    arr = vector_to_array(F.col(vec)) if dict(df.dtypes).get(vec) == "vector" else F.col(vec).cast("array<double>")
    base = df.select(F.col(key).cast("string").alias("__k"), arr.alias("x"))
    if frac < 1.0:
        base = base.sample(False, frac, seed)
    picks = base.select("__k", "x", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("__j"))
    picks = picks.select(
        "x",
        F.pmod(F.xxhash64(F.lit(seed), "__k", "__j"), F.lit(n_trees)).cast("int").alias("tree"),
        (F.pmod(F.xxhash64(F.lit(seed + 1), "__k", "__j"), F.lit(1 << 30)) / float(1 << 30)).alias("u"),
    )
    nodes = picks.groupBy("tree").applyInPandas(lambda p: _grow(p, psi, seed), schema=NODE_SCHEMA).toPandas()  # T x <2ψ rows
    eff_psi = int(max(2, min(psi, int(nodes.groupby("tree")["n_sample"].first().median()))))
    model = IsolationForestModel(nodes, eff_psi)
    if contamination is not None:
        scored = model.score_frame(df.select(vec), vec, "__s", raw=True)
        # sklearn: offset = percentile(-s, 100 * contamination); -decision = s + offset
        q = global_percentiles(scored.select((-F.col("__s")).alias("__ns")), [("off", "__ns", float(contamination))]).first()["off"]
        model.offset = float(q)
    return model


# J7 ---------------------------------------------------------------------------
def reconstruction_error(df: DataFrame, vec: str, k: int = 3, out: str = "reconstruction_error", fit_on: DataFrame | None = None):
    """Linear autoencoder: project standardised features on the top-k principal axes, reconstruct,
    mean squared error per row.  Fit (on ``fit_on``, else ``df``) = ``ml.feature.PCA``; apply = array expressions."""
    from pyspark.ml.feature import PCA, StandardScaler

    known = df if fit_on is None else fit_on
    scaler = StandardScaler(inputCol=vec, outputCol="__z", withMean=True, withStd=True).fit(known)
    z = scaler.transform(df)
    pca = PCA(k=k, inputCol="__z", outputCol="__p").fit(scaler.transform(known))
    # the axes are orthonormal: what the reconstruction leaves is |z|^2 - |projection|^2
    square = lambda v: F.aggregate(vector_to_array(F.col(v)), F.lit(0.0), lambda acc, x: acc + x * x)
    rows = pca.transform(z)
    err = F.greatest(square("__z") - square("__p"), F.lit(0.0)) / F.size(vector_to_array(F.col("__z")))
    return rows.withColumn(out, err).drop("__z", "__p"), pca


# J8 ---------------------------------------------------------------------------
def pca_2d(df: DataFrame, vec: str, fit_on: DataFrame | None = None):
    """Position on the first two principal axes of the standardised vectors, fitted on ``fit_on`` (else ``df``)."""
    from pyspark.ml.feature import PCA, StandardScaler

    known = df if fit_on is None else fit_on
    scaler = StandardScaler(inputCol=vec, outputCol="__z", withMean=True, withStd=True).fit(known)
    pca = PCA(k=2, inputCol="__z", outputCol="__xy").fit(scaler.transform(known))
    return project_2d(df, (scaler, pca)), (scaler, pca)


def project_2d(df: DataFrame, fitted, x: str = "pca_x", y: str = "pca_y") -> DataFrame:
    scaler, pca = fitted
    xy = vector_to_array(F.col("__xy"))
    return pca.transform(scaler.transform(df)).withColumns({x: xy[0], y: xy[1]}).drop("__z", "__xy")


# J9 ---------------------------------------------------------------------------
def _idw(x: np.ndarray, rx: np.ndarray, rxy: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows ``x`` by all distances to the reference ``rx``."""
    xy = np.empty((len(x), 2))
    step = max(1, 4_000_000 // max(1, rx.size))  # rows at a time: about 32 MB of differences
    for lo in range(0, len(x), step):
        d = np.sqrt(((x[lo : lo + step, None, :] - rx[None, :, :]) ** 2).sum(axis=2))
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        xy[lo : lo + step] = _weighted(np.take_along_axis(d, near, axis=1), rxy[near])
    return xy


def _weighted(d: np.ndarray, xy: np.ndarray) -> np.ndarray:
    w = 1.0 / (d + 1e-6)
    return (xy * (w / w.sum(axis=1, keepdims=True))[:, :, None]).sum(axis=1)


IDW_SPARE = 20  # candidates beyond k whose distances are computed exactly


def _idw_near(x: np.ndarray, rx: np.ndarray, rxy: np.ndarray, k: int) -> np.ndarray:
    """:func:`_idw` by way of candidates: squared distances from one matrix product pick them, exact distances decide.

    A row whose k-th neighbour is not sure to be among its candidates (rounding, ties of other positions, values that are
    not finite) is computed by all distances."""
    m = k + IDW_SPARE
    xy, sure, every = np.empty((len(x), 2)), np.zeros(len(x), bool), (rx * rx).sum(1)
    step = max(1, (1 << 19) // len(rx))  # rows at a time: 4 MB of squares
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        own = (part * part).sum(1)
        rough = every[None, :] - 2.0 * (part @ rx.T) + own[:, None]
        cand = np.argpartition(rough, m, axis=1)[:, : m + 1]
        beyond = np.take_along_axis(rough, cand[:, m:], axis=1)[:, 0]  # nothing outside the candidates is nearer
        cand = np.sort(cand[:, :m], axis=1)
        d = np.sqrt(((part[:, None, :] - rx[cand]) ** 2).sum(axis=2))
        order = np.argsort(d, axis=1, kind="stable")
        d, cand = np.take_along_axis(d, order, axis=1), np.take_along_axis(cand, order, axis=1)
        error = 1e-12 * (own + every.max()) + 1e-300
        # ties with the k-th neighbour are harmless if all of them have one position
        tied = (d == d[:, k - 1 : k]) & (rxy[cand] != rxy[cand[:, k - 1]][:, None, :]).any(axis=2) & (d[:, k - 1 : k] == d[:, k : k + 1])
        sure[lo : lo + step] = (d[:, k - 1] ** 2 + error < beyond) & ~tied.any(axis=1)
        xy[lo : lo + step] = _weighted(d[:, :k], rxy[cand[:, :k]])
    if not sure.all():
        xy[~sure] = _idw(x[~sure], rx, rxy, k)
    return xy


def idw_project(df: DataFrame, vec: str, ref_x: np.ndarray, ref_xy: np.ndarray, k: int = 12) -> DataFrame:
    """Inverse-distance weighted 2-D position from the k nearest of a bounded reference sample
    (e.g. the per-cluster plot sample): the reference is broadcast, the vectors alone go to Python in Arrow batches."""
    bc = df.sparkSession.sparkContext.broadcast((np.asarray(ref_x, float), np.asarray(ref_xy, float)))
    base = df.withColumn(vec, vector_to_array(F.col(vec)) if dict(df.dtypes).get(vec) == "vector" else F.col(vec))

    @F.arrow_udf("cluster_x double, cluster_y double")
    def position(vectors):
        import pyarrow as pa

        rx, rxy = bc.value
        kk, n = min(k, len(rx)), len(vectors)
        xy = np.full((n, 2), np.nan)
        if n and kk:
            x = np.asarray(vectors.flatten(), float).reshape(n, -1)
            # (candidates pay only if they are few among the reference)
            xy = (_idw_near if len(rx) > 4 * (kk + IDW_SPARE) else _idw)(x, rx, rxy, kk)
        return pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["cluster_x", "cluster_y"])

    out = base.withColumn("__at", position(F.col(vec).cast("array<double>")))
    return out.withColumns({c: F.col(f"__at.{c}") for c in ("cluster_x", "cluster_y")}).drop("__at")


# E12 --------------------------------------------------------------------------
def cluster_profile(df: DataFrame, cluster: str = "cluster_id", top: int = 3) -> DataFrame:
    """Per cluster: rows, mean area, median lease median and area, top-3 regions and types with counts."""
    base = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("rows"), F.avg("area_m2_clean").alias("mean_area_m2"))
    med = group_percentiles(df, [cluster], [("median_rent_deposit", "rent_deposit_median", 0.5), ("median_area_m2", "area_m2_clean", 0.5)])
    out = _null_safe_join(base, med, [cluster])
    for col, name in (("gu_name", "top_regions"), ("property_type", "top_types")):
        c = df.groupBy(cluster, col).agg(F.count(F.lit(1)).alias("n"))  # (cluster, value) counts, small
        w = Window.partitionBy(cluster).orderBy(F.col("n").desc(), F.col(col).asc_nulls_last())
        t = c.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= top)
        t = t.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("__r", F.col(col).alias("value"), "n"))).alias(name))
        out = _null_safe_join(out, t.select(cluster, F.transform(name, lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n"))).alias(name)), [cluster])
    return out


# J11 ----------------------------------------------------------------------------
METHODS = ("kmeans", "isolation_forest", "lof", "autoencoder")


def unsupervised_features(
    df: DataFrame, train: Column, methods: Sequence[str] = METHODS, cat: Sequence[str] = UNSUP_CAT, num: Sequence[str] = UNSUP_NUM,
    key: str = "row_key", k: int = 12, contamination: float = CONTAMINATION, neighbours: int = 35, axes: int = 3, seed: int = 42,
) -> DataFrame:
    """``df`` with the score columns of the chosen methods; design and methods are fitted on the ``train`` rows alone.

    kmeans: cluster_id, kmeans_distance, kmeans_robust_z; isolation_forest: isolation_score; lof: lof_score;
    autoencoder: autoencoder_error.  ``key`` tells rows apart (checked).
    """
    from fairlease.operators import lof, models

    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    if df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"{key} does not tell rows apart")
    framed = models.categorical_frame(unsupervised_frame(df).withColumn("__train", train), [*cat, *num], cat, num, keep=[key, "__train"])
    fit_rows = framed.filter("__train")
    x = materialize(models.design_pipeline(cat, num).fit(fit_rows).transform(framed).select(key, "__train", "features"))
    known = x.filter("__train")
    out = df
    if "kmeans" in methods:
        model = fit_kmeans(known, k, seed=seed)
        placed = centroid_distance(x, [c.tolist() for c in model.clusterCenters()], "features", None, "kmeans_distance")
        placed = materialize(placed.select(key, "__train", "cluster", "kmeans_distance"))
        scored, _ = robust_z(placed, "cluster", "kmeans_distance", fit_on=F.col("__train"))
        out = out.join(scored.select(key, F.col("cluster").alias("cluster_id"), "kmeans_distance", "kmeans_robust_z"), key, "left")
    if "isolation_forest" in methods:
        forest = fit_isolation_forest(known, "features", key, seed=seed, contamination=contamination)
        out = out.join(forest.score_frame(x.select(key, "features"), "features").select(key, "isolation_score"), key, "left")
    if "lof" in methods:
        out = out.join(lof.lof_scores(known, x, "features", key, k=neighbours, contamination=contamination).select(key, "lof_score"), key, "left")
    if "autoencoder" in methods:
        scored, _ = reconstruction_error(x, "features", axes, out="autoencoder_error", fit_on=known)
        out = out.join(scored.select(key, "autoencoder_error"), key, "left")
    return out
