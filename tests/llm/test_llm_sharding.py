import math
import struct
import zlib

import xxhash
from llm_cases import doc_frame, edge_texts, empty_docs
from pyspark.sql import functions as F

from fairlease.llm import sharding

M = 1 << 64


def spark_hash(key, shard):
    seed = 42
    if key is not None:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", key), seed)
    return xxhash.xxh64_intdigest(struct.pack("<i", shard), seed)


def brute_shard(key, weights):
    best = None
    for s, w in enumerate(weights):
        u = ((spark_hash(key, s) >> 12) + 0.5) / (1 << 52)
        score = (-w / math.log(u), -s)
        best = max(best, score) if best else score
    return -best[1]


def test_rendezvous_is_the_highest_score(spark):
    weights = [1.0, 2.0, 0.5, 4.0]
    keys = [None, 0, -5, *range(1000, 1300)]
    got = {r["k"]: r["s"] for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.rendezvous(F.col("k"), weights).alias("s")).collect()}
    assert got == {k: brute_shard(k, weights) for k in keys}


def test_layout(spark):
    rows = edge_texts()
    out = sharding.shard_layout(doc_frame(spark, rows), [1.0] * 16).toPandas()
    assert sorted(out["doc_id"].fillna(-1)) == sorted(-1 if i is None else i for i, _ in rows)
    by_id = {i: t for i, t in rows}
    for r in out.itertuples():
        key = None if math.isnan(r.doc_id) else int(r.doc_id)
        raw = (by_id[key] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "key"
        assert r.shard == brute_shard(key, [1.0] * 16)
        assert r.grown_shard in (r.shard, 16) and r.grown_shard == brute_shard(key, [1.0] * 17)
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_hot_key_many_buckets_and_empty(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 2)
    docs = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    out = sharding.shard_layout(docs, [1.0] * 4).toPandas()
    assert len(out) == 300
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert out[out.doc_id == 7]["shard"].nunique() == 1
    assert sharding.shard_layout(empty_docs(spark), [1.0] * 4).count() == 0


def test_shares_follow_weights(spark):
    out = spark.range(20000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 20000 for r in out}
    assert abs(share[1] - 0.75) < 0.02
