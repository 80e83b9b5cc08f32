"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashes of its words, its neighbouring word pairs and its pairs with one
or two words between, each counted once.  Training runs in Spark over a bounded sample of labelled
rows: every shard of the sample takes FTRL-proximal steps (per-coordinate rates, L1 and L2) from
the shared state, and the shards' states are averaged between rounds.  L1 leaves few non-zero
weights, which are broadcast (at most ``2 ** BITS`` of 12 bytes).

Defined results: null and empty texts have no features and score by the intercept, as do texts
without words; labels that are null are left out; repeated documents are scored alike; without any
label every score is 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlease.llm.shared import stage_table
from fairlease.llm.text import RollingHash, blocks, mix, sorted_unique, word_spans

BITS = 20
#: Word gaps of the pairs: neighbours, and skip-grams over one and over two words.
GAPS = (1, 2, 3)
_PAIR = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _separators() -> np.ndarray:
    """Words are runs of ASCII letters, digits and non-ASCII bytes."""
    sep = np.ones(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        sep[a:b] = False
    return sep


SEPARATORS = _separators()


@dataclass(frozen=True)
class Settings:
    max_rows: int = 24_000  # bound of the training sample, in expectation
    shards: int = 4
    rounds: int = 3
    epochs: int = 6
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.05


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each feature, feature) for blocks of texts; a text may repeat a feature."""
    for lo, hi, data, offsets in blocks(column):
        starts, ends, before = word_spans(data, offsets, SEPARATORS)
        h = RollingHash(data).of(starts, ends)
        row = np.repeat(np.arange(lo, hi), np.diff(before))
        rows, found = [row], [h]
        for gap in GAPS:
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                rows.append(row[gap:][same])
                found.append(mix(h[:-gap] * _PAIR[0] + h[gap:] * _PAIR[gap])[same])
        yield lo, hi, np.concatenate(rows), np.concatenate(found) >> np.uint64(64 - BITS)


class Ftrl:
    """FTRL-proximal state over hashed binary features; slot ``2 ** BITS`` is the intercept."""

    def __init__(self, s: Settings, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.s = s
        self.z = np.zeros((1 << BITS) + 1) if z is None else z
        self.n = np.zeros((1 << BITS) + 1) if n is None else n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        l1 = np.where(at == 1 << BITS, 0.0, s.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def step(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] = grown


STATE = "chunk int, at binary, z binary, n binary"
CHUNKS = 16


def _state_rows(at: np.ndarray, z: np.ndarray, n: np.ndarray) -> pa.Table:
    """Coordinates and their state in ``CHUNKS`` rows by coordinate range."""
    chunk = at * CHUNKS // ((1 << BITS) + 1)
    cuts = np.searchsorted(chunk, np.arange(CHUNKS + 1))
    part = lambda x, t: pa.array([x[a:b].astype(t).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    return pa.table({"chunk": pa.array(range(CHUNKS), pa.int32()), "at": part(at, np.uint32), "z": part(z, np.float32), "n": part(n, np.float32)})


def _state(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for at, z, n in zip(*(table[c].to_pylist() for c in ("at", "z", "n")), strict=True):
        yield np.frombuffer(at, np.uint32).astype(np.int64), np.frombuffer(z, np.float32).astype(float), np.frombuffer(n, np.float32).astype(float)


def _steps(texts: pa.Table, state: pa.Table, s: Settings) -> pa.Table:
    """The state after FTRL steps over one shard's texts."""
    model = Ftrl(s)
    for at, z, n in _state(state):
        model.z[at], model.n[at] = z, n
    texts = texts.sort_by("order").combine_chunks()
    rows = []
    for lo, hi, row, feature in features(texts["text"]):
        keys = sorted_unique((row.astype(np.uint64) << np.uint64(32)) | feature)
        cuts = np.searchsorted(keys >> np.uint64(32), np.arange(lo, hi + 1))
        small = keys.astype(np.uint32)
        rows += [small[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    labels = texts["label"].to_pylist()
    for _ in range(s.epochs):
        for row, y in zip(rows, labels, strict=True):
            model.step(row.astype(np.int64), y)
    used = np.flatnonzero(model.n)
    return _state_rows(used, model.z[used], model.n[used])


def _round(state, s: Settings):
    """One task takes whole shards, each from the state that all share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        texts = pa.Table.from_batches(held)
        shards = texts["shard"].to_numpy()
        for shard in sorted(set(shards.tolist())):
            yield from _steps(texts.filter(pa.array(shards == shard)), pa.table(state.value), s).to_batches()

    return run


def _averaged(parts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A coordinate's state is the mean over the shards that met it."""
    size = (1 << BITS) + 1
    z, n, seen = np.zeros(size), np.zeros(size), np.zeros(size)
    for at, z_part, n_part in sorted(_state(parts), key=lambda p: (len(p[0]), p[1].sum())):
        z[at] += z_part
        n[at] += n_part
        seen[at] += 1
    at = np.flatnonzero(seen)
    return at, z[at] / seen[at], n[at] / seen[at]


def _merge(parts: pa.Table) -> pa.Table:
    at, z, n = _averaged(parts)
    return _state_rows(at, z, n).filter(pa.array(np.arange(CHUNKS) == parts["chunk"][0].as_py()))


def train(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, intercept) from rows of ``labels`` (doc_id, label) joined to ``docs``.

    Beyond ``max_rows`` labelled documents a hash of doc_id picks about that many; of rows that
    share a doc_id the smallest text is learnt from.
    """
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    total = known.count()
    keep = F.lit(True) if total <= s.max_rows else F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) < int((1 << 30) * s.max_rows / total)
    picked = F.broadcast(known.where(keep))  # about max_rows rows of two numbers
    # one text a doc_id, whatever repeats: the bound of the labels is one of the rows
    texts = docs.join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "label", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(s.shards)).cast("int").alias("shard"), F.lower("text").alias("text"))
    kept = stage_table(rows, "toxic-rows").withColumn("order", F.xxhash64("doc_id", F.lit("order")))
    spark = kept.sparkSession
    state = {"at": [], "z": [], "n": []}
    dealt = kept.repartitionByRange(s.shards, "shard")  # a task a shard
    for _ in range(s.rounds):
        stepped = dealt.mapInArrow(_round(spark.sparkContext.broadcast(state), s), STATE)
        # 12 bytes for each of at most 2 ** BITS coordinates
        rows = stepped.groupBy("chunk").applyInArrow(_merge, STATE).collect()
        state = {c: [bytes(r[c]) for r in rows] for c in ("at", "z", "n")}
    model = Ftrl(s)
    found = []
    for at, z, n in _state(pa.table(state)):
        model.z[at], model.n[at] = z, n
        w = model.weights(at)
        found += zip(at[w != 0].tolist(), w[w != 0].tolist(), strict=True)
    found.sort()
    w = dict(found)
    intercept = float(w.pop(1 << BITS, 0.0))
    return np.array(list(w), np.uint32), np.array(list(w.values())), intercept


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str]) -> DataFrame:
    """``docs`` columns ``keep`` plus ``score``, the probability of label 1, over whole texts."""
    at, w, intercept = model
    sent = docs.sparkSession.sparkContext.broadcast((at, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for batch in batches:
            sums = np.full(batch.num_rows, intercept)
            for _, _, row, feature in features(batch.column(batch.num_columns - 1)):
                weighted = np.flatnonzero(dense[feature])
                keys = sorted_unique((row[weighted].astype(np.uint64) << np.uint64(32)) | feature[weighted])
                np.add.at(sums, (keys >> np.uint64(32)).astype(np.int64), dense[keys & np.uint64(0xFFFFFFFF)])
            p = 1 / (1 + np.exp(-np.clip(sums, -30, 30))) if len(at) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], "score"])

    rows = docs.select(*keep, F.lower("text").alias("__lowered"))
    return rows.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    """True for the documents that no model learns from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    learn = labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id")))
    model = train(docs.select("doc_id", "text"), learn, settings)
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
