import math
import re
import zlib

import numpy as np
import pyarrow as pa
from llm_cases import doc_frame, edge_texts, empty_docs, sentence

from fairlease.llm import toxicity as tox
from fairlease.llm.shared import table

SF = "/root/testdata/sf0.1"


def test_features_are_words_pairs_and_skips():
    texts = ["alpha beta gamma delta eps", None, "", "!!!", "alpha", "alpha beta, ALPHA beta"]
    got = {i: [] for i in range(len(texts))}
    for _, _, row, feature in tox.features(pa.array(texts)):
        for r, f in zip(row, feature, strict=True):
            got[r].append(int(f))
    assert [len(got[i]) for i in range(6)] == [5 + 4 + 3 + 2, 0, 0, 0, 1, 4 + 3 + 2 + 1]
    assert got[4][0] in got[0] and got[4][0] in got[5]
    # the pair (alpha, beta) is one feature wherever it stands
    assert got[5][4] in got[0]


def test_ftrl_steps_by_hand():
    s = tox.Settings(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    model = tox.Ftrl(s)
    z, n = {}, {}
    bias = 1 << tox.BITS

    def weight(i):
        l1 = 0 if i == bias else s.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    rng = np.random.default_rng(0)
    for _ in range(60):
        at = np.unique(rng.integers(0, 12, 4))
        label = int(5 in at)
        model.step(at, label)
        used = [*at.tolist(), bias]
        w = {i: weight(i) for i in used}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in used:
            grown = n.get(i, 0.0) + g * g
            z[i] = z.get(i, 0.0) + g - (math.sqrt(grown) - math.sqrt(n.get(i, 0.0))) / s.alpha * w[i]
            n[i] = grown
    for i in [*range(12), bias]:
        assert abs(model.weights(np.array([i]))[0] - (weight(i) if i in z else 0.0)) < 1e-9
    assert model.weights(np.array([5]))[0] > 0 and (model.weights(np.arange(1000)) == 0).sum() > 900


def test_scores_by_brute_force_and_hostile_rows(spark):
    rows = edge_texts()
    docs = doc_frame(spark, rows)
    some = next(tox.features(pa.array(["river stone"])))[3]
    model = (np.array(sorted({int(f) for f in some}), np.uint32), np.array([1.5, -0.5, 0.25]), -1.0)
    weight = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    out = tox.score(docs, model, ["doc_id"]).collect()
    assert len(out) == len(rows)
    for r, (i, text) in zip(sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        own = set()
        for _, _, _, f in tox.features(pa.array([(text or "").lower()])):
            own = {int(x) for x in f}
        assert r["doc_id"] == i and abs(r["score"] - 1 / (1 + math.exp(1.0 - sum(weight.get(f, 0) for f in own)))) < 1e-9


def test_no_labels_no_rows_null_labels(spark):
    labels = spark.createDataFrame([(3, None), (None, 1)], "doc_id long, toxic int")
    docs = doc_frame(spark, edge_texts())
    assert {r["score"] for r in tox.score_documents(docs, labels).collect()} == {0.0}
    assert tox.score_documents(empty_docs(spark), labels).count() == 0


def test_learns_a_planted_word(spark):
    import random

    rng = random.Random(3)
    rows = [(i, sentence(rng, 60) + (" vile" if i % 4 == 0 else "") + " " + sentence(rng, 30)) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    out = tox.score_documents(doc_frame(spark, rows), labels).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out)


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    out = tox.score_documents(table(spark, SF, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    clean = out[out.toxic == 0]
    assert (out.predicted == out.toxic).mean() > 0.94 and clean.predicted.mean() < 0.01
    assert re.fullmatch(r"\d+", str(len(out)))
