import collections
import zlib

import numpy as np
from llm_cases import doc_frame, edge_texts, empty_docs
from pyspark.sql import functions as F

from fairlease.llm import language as lang
from fairlease.llm.shared import table
from fairlease.llm.text import blocks

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    data = (text or "").encode()
    words, word = [], b""
    for b in data + b" ":
        if 65 <= b < 91 or 97 <= b < 123 or b >= 128:
            word += bytes([b])
        elif word:
            words.append(word)
            word = b""
    counts = collections.Counter()
    for w in words:
        marked = b"_" + w + b"_"
        for n in range(1, lang.MAX_N + 1):
            for i in range(len(marked) - n + 1):
                g = marked[i : i + n]
                if g != b"_":
                    counts[int.from_bytes(g, "little")] += 1
    return counts


def texts():
    return [None if t is None else t.lower() for _, t in edge_texts()]


def test_counts_and_ranks_by_brute_force():
    import pyarrow as pa

    found = [collections.Counter() for _ in texts()]
    ranks = [[] for _ in texts()]
    for lo, hi, data, offsets in blocks(pa.array(texts()), 5000):
        row, code, n = lang.ngram_counts(data, offsets)
        for r, c, k in zip(row, code, n, strict=True):
            found[lo + r][int(c)] += int(k)
        for r, c, k in zip(*lang.ranked(row, code, n, hi - lo, 50), strict=True):
            assert len(ranks[lo + r]) == k
            ranks[lo + r].append(int(c))
    for t, own, top in zip(texts(), found, ranks, strict=True):
        want = brute_counts(t)
        assert own == want
        assert top == [g for g, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:50]]


def test_out_of_place_distance(spark):
    rows = edge_texts()
    s = lang.Settings(profile=40)
    profiles = {"aa": [g for g, _ in brute_counts("the river and the stone").most_common(40)], "bb": [g for g, _ in brute_counts("quiet lamp in winter").most_common(40)]}
    out = lang.predict(doc_frame(spark, rows), profiles, ["doc_id", "text"], s).collect()
    assert len(out) == len(rows)
    for r in out:
        text = (r["text"] or "").lower()
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = [g for g, _ in sorted(brute_counts(text).items(), key=lambda x: (-x[1], x[0]))[:40]]
        far = {}
        for name, p in profiles.items():
            place = {g: i for i, g in enumerate(p)}
            far[name] = sum(abs(place[g] - i) if g in place else 40 for i, g in enumerate(own)) / (len(own) * 40)
        best = min(sorted(far), key=lambda k: far[k])
        assert r["lang_pred"] == best and abs(r["score"] - (1 - far[best])) < 1e-9


def test_nothing_learned_and_empty(spark):
    docs = doc_frame(spark, edge_texts()).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in lang.identify_documents(docs).collect()} == {("und", 0.0)}
    assert lang.identify_documents(empty_docs(spark)).count() == 0


def test_bounded_sample_is_by_language(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("alpha beta").alias("text"), F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("lang"))
    profiles = lang.learn_profiles(docs, lang.Settings(max_docs=50))
    assert set(profiles) == {"rare", "common"} and all(profiles.values())


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    out = lang.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert all(out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1))
    held = out[out.held_out]
    assert np.mean(held.lang == held.lang_pred) > 0.98
