"""Ordered target statistics: no row's own label, whatever the buckets; the learner on them saves and loads."""

import hashlib
import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from fairlease.operators import models


def frame(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = "hot" if i % 3 == 0 else f"c{rng.integers(0, 40)}" if i % 7 else None
        y = (1.0 if c == "hot" else -1.0) + float(rng.normal()) * 0.1
        rows.append((f"k{i}", c, float(rng.normal()) if i % 5 else None, y if i % 11 else None))
    return rows, spark.createDataFrame(rows, "row_key string, c string, x double, target double")


@pytest.mark.parametrize("rows_per_bucket", [7, 100, 10**6])
def test_codes_by_brute_force(spark, rows_per_bucket):
    rows, df = frame(spark)
    got = {r["row_key"]: r["c__te"] for r in models.ordered_target_statistics(df, ["c"], "target", prior_weight=2.0, rows_per_bucket=rows_per_bucket).collect()}
    mean = np.mean([y for *_, y in rows if y is not None])
    sums, counts, want = {}, {}, {}
    for k, c, _, y in sorted(rows, key=lambda r: hashlib.md5(f"42|{r[0]}".encode()).hexdigest()):
        want[k] = (sums.get(c, 0.0) + 2.0 * mean) / (counts.get(c, 0) + 2.0)
        if y is not None:
            sums[c], counts[c] = sums.get(c, 0.0) + y, counts.get(c, 0) + 1
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-12)


def test_learner_on_ordered_codes(spark):
    _, df = frame(spark, 600, 3)
    df = df.withColumn("c", F.coalesce("c", F.lit("__MISSING__"))).where("target is not null")
    spec = {"kind": "gbt", "maxDepth": 3, "maxIter": 5, "categories": "ordered"}
    m = models.fit_model(df.where("hash(row_key) % 4 <> 0"), df.where("hash(row_key) % 4 = 0"), ["c"], ["x"], spec)
    path = tempfile.mkdtemp(prefix="fairlease-ots-") + "/m"
    m.save(path)
    asked = spark.createDataFrame([("a", "hot", 0.0), ("b", "c1", None), ("c", "never seen", 0.0)], "row_key string, c string, x double")
    got = {r["c"]: r["prediction"] for r in PipelineModel.load(path).transform(asked).collect()}
    assert got["hot"] > 0.5 > -0.5 > got["c1"] and -1.2 < got["never seen"] < 1.2
    out = models.predict({"one": m, "two": m}, df)
    assert not [c for c in out.columns if c.startswith("__") or c.endswith("__te")]
