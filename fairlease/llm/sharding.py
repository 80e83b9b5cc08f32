"""Rendezvous hashing of stable record keys over weighted shards.

Every record scores each shard with ``-weight / ln(u(key, shard))`` and goes to the highest
score.  A shard's score depends on the key and that shard alone, so a new shard only takes the
records it wins and no record moves between old shards.  Built-in functions only.

Defined results: a null key is a key like any other; a null text has size 1 and checksum 0;
repeated rows share their shard and get separate slots; an empty table gives no rows; extra
columns are kept by ``rendezvous`` and left out by ``shard_layout``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlease.llm.shared import checkpointed

#: Rows that one slot bucket of a shard holds on average.
ROWS_PER_BUCKET = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) of ``key`` among ``len(weights)`` shards of the given weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be a non-empty list of positive numbers")
    scored = []
    for shard, weight in enumerate(weights):
        # 52 hash bits as a double strictly between 0 and 1
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
        scored.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("neg")))
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["neg"]).cast("int")


def shard_layout(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """Per record: size, checksum, shard, slot within the shard, and the shard after one more joins.

    Slots count from 0 without gaps.  Rows are numbered in buckets of (shard, key hash) and
    shifted by the sizes of the buckets before, so no task holds a shard; equal rows are counted
    before the shuffle and expanded after it, so a hot key costs one row.
    """
    grown = [*weights, grown_weight]
    rows = (
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    rows = checkpointed(rows)
    buckets = max(1, -(-rows.count() // (ROWS_PER_BUCKET * len(weights))))
    placed = rows.select(
        "*",
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), grown).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("slot")), F.lit(buckets)).alias("bucket"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "bucket")
        .agg(F.sum("copies").alias("held"))
        .select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("bucket_start"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    return numbered.join(starts, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("bucket_start") + F.col("first"), F.col("bucket_start") + F.col("first") + F.col("copies") - 1)).alias("slot"),
        "grown_shard",
    )
