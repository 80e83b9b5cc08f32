import math

import numpy as np
from pyspark.sql import functions as F

from fairlease.llm import ann
from fairlease.llm.shared import table

SCHEMA = "vec_id long, embedding array<float>, score double, rank int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 1.0, 2, 3) for i, e in rows], SCHEMA)


def brute(rows, k=20, every=20):
    kept = {}
    for i, e in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e):
            kept.setdefault(i, np.array(e, np.float32).astype(float))
    out = set()
    for q in kept:
        if q % every == 0:
            near = sorted(((-float(kept[q] @ v), i) for i, v in kept.items() if i != q))[:k]
            out |= {(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(near)}
    return out


def got(spark, rows, s=ann.Settings()):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(frame(spark, rows), s).collect()}


def test_small_tables_are_exact_with_hostile_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [None, 1, 1, 1, 1, 1]), (1002, [float("nan")] * 6), (1003, [float("inf"), 0, 0, 0, 0, 0]), (1004, [0.0] * 6), (1020, [])]
    rows += [(2000 + i, [3, 3, 3, 3, 3, 3]) for i in range(80)]  # many equal vectors, all ties
    rows += [(2000, [3, 3, 3, 3, 3, 3])]
    assert got(spark, rows) == brute(rows)
    assert ann.nearest(frame(spark, rows).withColumn("vec_id", F.when(F.col("vec_id") == 0, F.lit(None)).otherwise(F.col("vec_id")))).where("query_id is null or vec_id is null").count() == 0


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (21, [0.5, 0.5])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(0, [1.0])]) == set()
    assert got(spark, []) == set()


def test_other_norms(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 10)).tolist()) for i in range(400)]
    assert got(spark, rows) == brute(rows)


def test_recall_of_a_real_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    s = ann.Settings(visit=14.0, visit_least=0, sample=2000, leaf=16, part_rows=4000)
    want, mine = brute(rows), got(spark, rows, s)
    assert len(mine) == len(want)
    recall = len({x[::2] for x in mine} & {x[::2] for x in want}) / len(want)
    assert recall >= 0.9


def test_dealt_leaves_and_a_larger_index_find_as_much(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    s = ann.Settings(visit=30.0, visit_least=0, sample=700, leaf=16, part_rows=256)  # leaves dealt over 5 tasks
    want, mine = brute(rows), got(spark, rows, s)
    assert len(mine) == len(want)
    assert len({x[::2] for x in mine} & {x[::2] for x in want}) / len(want) >= 0.9


def test_double_vectors_keep_their_precision(spark):
    rng = np.random.default_rng(6)
    data = [(i, rng.normal(size=5).tolist()) for i in range(200)] + [(300, None), (301, [float("nan")] * 5), (302, [0.1] * 4)]
    kept = {i: np.array(e) for i, e in data if e is not None and len(e) == 5 and np.isfinite(e).all()}
    for kind, read in (("array<double>", float), ("array<float>", np.float32), ("array<decimal(20,6)>", lambda x: round(x, 6))):
        df = spark.createDataFrame(data[:200] + data[-3:-2] + data[-1:], "vec_id int, embedding array<double>").select("vec_id", F.col("embedding").cast(kind))
        out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df).collect()}
        held = {i: np.array([float(read(x)) for x in e]) for i, e in kept.items() if i < 200}
        for q in range(0, 200, 20):
            near = sorted(((-float(held[q] @ v), i) for i, v in held.items() if i != q))[:20]
            assert [out[q, r + 1][0] for r in range(20)] == [i for _, i in near]
            assert np.allclose([out[q, r + 1][1] for r in range(20)], [-x for x, _ in near], rtol=1e-14)


def test_visited_share_falls_beyond_the_sample():
    s = ann.Settings()
    share = [ann.visited_rows(n, min(n, s.sample), s) / min(n, s.sample) for n in (65_536, 400_000, 10**9)]
    assert share[0] > share[1] > share[2] and abs(share[2] / share[0] - (10**9 / 65_536) ** -0.15) < 1e-3


def test_query_recall_on_the_table(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    v = vectors.toPandas()
    e = np.stack(v.embedding).astype(float)
    out = ann.nearest(vectors).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for i in np.flatnonzero(v.vec_id % 20 == 0):
        s = e @ e[i]
        s[i] = -np.inf
        hits.append(len(set(v.vec_id.to_numpy()[np.argsort(-s)[:20]]) & out[v.vec_id[i]]) / 20)
    assert np.mean(hits) >= 0.9


def test_forest_leaves_hold_every_vector_once_a_tree():
    rng = np.random.default_rng(3)
    x = ann.lifted(rng.normal(size=(500, 4)), 5.0)
    s = ann.Settings(trees=3, leaf=10)
    forest = ann.grow(x, 5.0, s)
    leaves = forest.leaves(x)
    held = np.bincount(leaves.ravel(), minlength=len(forest.leaf_sizes))
    # a vector whose projection is the median itself may go either way by a rounding error
    assert forest.leaf_sizes.sum() == held.sum() == 1500 and np.abs(held - forest.leaf_sizes).max() <= 3
    q = ann.lifted_query(rng.normal(size=(1, 4)), 5.0)[0]
    assert sorted(forest.search(q, 10**9)) == list(range(len(forest.leaf_sizes)))
    assert set(forest.search(q, 1)) <= set(leaves.ravel().tolist())
