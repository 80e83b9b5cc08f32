import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import doc_frame, edge_texts, empty_docs, sentence
from pyspark.sql import functions as F

from fairlease.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id to (set size, smallest linked id), by all pairs of distinct sets."""
    sets = {}
    for i, t in rows:
        s = shingles(t)
        if s:
            sets.setdefault(s, []).append(i)
    points = list(sets)
    group = list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            k = len(points[i] & points[j])
            if 100 * k >= 75 * (len(points[i]) + len(points[j]) - k) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for p, g in zip(points, group, strict=True):
        low[g] = min(low.get(g, min(sets[p])), min(sets[p]))
    of = {p: low[g] for p, g in zip(points, group, strict=True)}
    return {(i, len(shingles(t)), of.get(shingles(t), i)) for i, t in rows}


def near_rows(seed, n, families, length=40):
    rng = random.Random(seed)
    bases = [sentence(rng, rng.randrange(3, length)).split() for _ in range(families)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        if rng.random() < 0.3:
            w += sentence(rng, rng.randrange(1, 8)).split()
        rows.append((i * 3 + 1, " ".join(w)))
    rng.shuffle(rows)
    return rows


def got(spark, rows, s=jaccard.Settings()):
    out = jaccard.join_documents(doc_frame(spark, rows), s).collect()
    assert len(out) == len(rows)
    return {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out}


def test_shingle_sets():
    texts = [t for _, t in edge_texts()]
    for t, x in zip(texts, jaccard.sets_of(pa.array(texts), 5), strict=True):
        assert len(x) == len(shingles(t)) and (np.diff(x.astype(np.float64)) >= 0).all()
    a, b = jaccard.sets_of(pa.array(["A b C d e f", "x a b c D e"]), 5)
    assert len(np.intersect1d(a, b)) == 1


def test_hostile_rows(spark):
    rows = [r for r in edge_texts() if r[0] is not None]
    assert got(spark, rows) == brute(rows)
    with_null = jaccard.join_documents(doc_frame(spark, edge_texts())).where("doc_id is null").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in with_null] == [(1, None)]
    assert jaccard.join_documents(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_by_brute_force(spark, seed):
    rows = near_rows(seed, 260, 12)
    assert got(spark, rows) == brute(rows)


def test_large_regions_by_brute_force(spark):
    rows = near_rows(5, 220, 3, 60)
    want = brute(rows)
    assert got(spark, rows, jaccard.Settings(region_max=8)) == want
    assert got(spark, rows, jaccard.Settings(region_max=40)) == want


def test_a_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(45)]
    out = got(spark, rows)
    assert out == brute(rows) and {c for _, _, c in out} == {0}


def test_link_region_against_all_pairs():
    rng = np.random.default_rng(3)
    s = jaccard.Settings()
    for _ in range(20):
        base = rng.choice(10_000, 60, replace=False)
        points = []
        for _ in range(25):
            x = base.copy()
            x[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(10_000, 99_999)
            points.append(np.unique(x[: rng.integers(20, 61)]).astype(np.uint64))
        group = list(range(25))

        def merge(group, i, j):
            return [group[j] if g == group[i] else g for g in group]

        want = group
        for i in range(25):
            for j in range(i):
                k = len(np.intersect1d(points[i], points[j]))
                if 100 * k >= 75 * (len(points[i]) + len(points[j]) - k):
                    want = merge(want, i, j)
        mine = group
        for i, j in jaccard.link_region(points, int(rng.integers(25)), s):
            mine = merge(mine, i, j)
        same = lambda g: {tuple(k for k in range(25) if g[k] == c) for c in set(g)}
        assert same(mine) == same(want)


def test_link_region_of_a_window_against_all_pairs():
    s = jaccard.Settings()
    rng = np.random.default_rng(5)
    # windows of 60 at offsets 18, 16 and 8: the pivot is near the second, which alone is near the third
    cases = [([np.arange(k, k + 60, dtype=np.uint64) for k in (18, 16, 8)], np.array([True, True, False]))]
    for _ in range(20):
        points = [np.arange(k, k + 60, dtype=np.uint64) for k in rng.integers(0, 120, 30)]
        cases.append((points, rng.random(30) < 0.5))
    for points, left in cases:
        n = len(points)
        mine = jaccard.Joined(n)
        for i, j in jaccard.link_region(points, 0, s, left):
            mine.join(i, np.array([j]))
        for i in np.flatnonzero(left):
            for j in range(n):
                k = len(np.intersect1d(points[i], points[j]))
                if 100 * k >= 75 * (len(points[i]) + len(points[j]) - k):
                    assert mine.group[i] == mine.group[j]


def test_could_link_keeps_every_linked_pair():
    rng = np.random.default_rng(4)
    s = jaccard.Settings()
    n, place = rng.integers(1, 80, 60), None
    place = (rng.random(60) * (n // 4 + 1)).astype(int)
    keep = jaccard.could_link(n, place, s)
    for i in range(60):
        for j in range(60):
            overlap = min(n[i] - place[i], n[j] - place[j], n[i], n[j])
            if i != j and 100 * overlap >= 75 * (n[i] + n[j] - overlap):
                assert keep[i] and keep[j]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 200)]
    out = {r["node"]: r["component"] for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{x: 100 for x in range(100, 140)}, 200: 200, 201: 200}
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1
