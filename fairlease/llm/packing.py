"""Packing tokenised documents into fixed-size sequences with a grouping genetic algorithm.

Documents are tokenised whole (plus an end id), only longer ones are cut, and every piece shorter
than a sequence is an item of bin packing.  Items are dealt at random into blocks of a few
thousand.  For each block several islands (tasks of their own) evolve packings: a crossover takes
whole well-filled bins of one parent into the other, drops the other's bins that hold the same
items, and puts the displaced items back by best fit; after each epoch every island sends its best
packing to the next one.  An island stops once it meets the block's lower bound.  The pieces of
bins that stay underfilled are dealt anew and packed again, until one block holds them all.

Defined results: null text is empty, an empty document is its end id alone; repeated rows are
packed each for itself; equal sizes are interchangeable; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlease.llm.shared import checkpointed, stage_table
from fairlease.llm.text import LARGE_BLOCK, RollingHash, WordTable, blocks, gather, word_spans

END_ID = 0
#: ASCII white space: space and 9 to 13.
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    block_items: int = 2048  # items of a block, on average
    islands: int = 2
    epochs: int = 2
    generations: int = 4
    population: int = 4
    refill_below: float = 0.995  # bins filled less are packed again in the next level


# tokenising


class WordIds:
    """Token ids of words, tokenised once each: the tokenizer never joins text over ASCII white space."""

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = WordTable(keep, {}, "ids", np.uint32)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        raw = data.tobytes()

        def make(at: np.ndarray) -> dict:
            words = [raw[a:b].decode() for a, b in zip(starts[at], ends[at], strict=True)]
            ids = []
            for i in range(0, len(words), 2048):
                ids += [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + 2048], add_special_tokens=False)]
            return {"ids": ids}

        slot, _, values, firsts = self.table.resolve(RollingHash(data).of(starts, ends), make)
        return gather(slot, values, firsts)


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def encode_texts(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text, end id included."""
    cache = word_ids(path)
    for _, _, data, offsets in blocks(column, LARGE_BLOCK):
        starts, ends, before = word_spans(data, offsets, WHITE)
        ids, sizes = cache.encode(data, starts, ends)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[before]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.append(ids[a:b], np.uint32(END_ID))


def cut_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, length, crc = [], [], [], []
            for i, ids in enumerate(encode_texts(batch.column(1), path)):
                ids = ids.astype("<u4", copy=False)
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    row.append(i)
                    piece.append(k // capacity)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            piece_a = np.array(piece, np.int32)
            yield pa.record_batch({
                "doc_id": batch.column(0).take(pa.array(row, pa.int64())),
                "piece": pa.array(piece_a),
                "start": pa.array(piece_a.astype(np.int64) * capacity),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# packing one block


def best_fit(sizes: np.ndarray, items: list[int], bin_of: np.ndarray, room: list[tuple[int, int]], next_bin: int, capacity: int) -> int:
    """Put ``items`` (in this order) into the fullest bin they fit, else a new one; ``room`` is sorted (space left, bin)."""
    for i in items:
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, next_bin = capacity, next_bin, next_bin + 1
        bin_of[i] = b
        if left > size:
            insort(room, (left - size, b))
    return next_bin


def fills(sizes: np.ndarray, bin_of: np.ndarray) -> np.ndarray:
    return np.bincount(bin_of, sizes, minlength=int(bin_of.max(initial=-1)) + 1).astype(np.int64)


def fitness(sizes: np.ndarray, bin_of: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then a larger mean square of how full they are; larger is better."""
    f = fills(sizes, bin_of)
    f = f[f > 0]
    return -len(f), float(np.square(f / capacity).mean()) if len(f) else 0.0


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``a`` with a random half of the well-filled bins of ``b`` taken in whole."""
    fb = fills(sizes, b)
    good = np.flatnonzero(fb >= np.quantile(fb[fb > 0], 0.5))
    taken = np.zeros(len(fb), bool)
    taken[good[rng.random(len(good)) < 0.5]] = True
    moved = taken[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[moved]] = True  # these bins of a hold items that the new bins bring: they go
    displaced = np.flatnonzero(hit[a] & ~moved)
    child = np.where(moved, b + len(hit), a)
    child[displaced] = -1
    names, child_kept = np.unique(child[child >= 0], return_inverse=True)
    child[child >= 0] = child_kept
    held = np.bincount(child_kept, sizes[child >= 0], minlength=len(names)).astype(np.int64)
    room = sorted((int(capacity - h), k) for k, h in enumerate(held) if h < capacity)
    order = displaced[np.lexsort((rng.random(len(displaced)), -sizes[displaced]))]
    best_fit(sizes, order.tolist(), child, room, len(names), capacity)
    return child


def evolve(sizes: np.ndarray, immigrants: list[np.ndarray], s: Settings, seed: int) -> list[np.ndarray]:
    """The island's population, best first."""
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // s.capacity)
    people = list(immigrants)
    while len(people) < s.population and not (people and -fitness(sizes, people[-1], s.capacity)[0] == bound):
        noise = rng.random(len(sizes)) * (0 if not people and seed % s.islands == 0 else s.capacity / 16)
        person = np.full(len(sizes), -1, np.int64)
        best_fit(sizes, np.argsort(-(sizes + noise), kind="stable").tolist(), person, [], 0, s.capacity)
        people.append(person)
    score = lambda p: fitness(sizes, p, s.capacity)
    people = sorted(people, key=score, reverse=True)
    for _ in range(s.generations):
        if -score(people[0])[0] == bound or len(people) < 2:
            break
        i, j = rng.permutation(len(people))[:2]
        people = sorted([*people, crossover(sizes, people[i], people[j], s.capacity, rng), crossover(sizes, people[j], people[i], s.capacity, rng)], key=score, reverse=True)[: s.population]
    return people


def pack_blocks(items: DataFrame, n_blocks: int, s: Settings, level: int) -> DataFrame:
    """Add ``bin`` (unique within the level) and ``bin_fill`` to items (item, length).

    Islands of a block are separate rows, so separate tasks may evolve them; elites travel with
    the state table between epochs.
    """
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(n_blocks)))
    packs = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "item"))).alias("held"))  # about block_items each
    packs = stage_table(packs, f"pack-{level}")
    islands = packs.select("block", F.col("held.length").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(s.islands - 1))).alias("island"))
    state = islands.select("block", "island", "sizes", F.lit(None).cast("array<binary>").alias("people"))
    schema = "block long, island int, people array<binary>"

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    old = [np.frombuffer(p, np.int32).astype(np.int64) for p in row["people"] or []]
                    seed = (row["block"] * s.epochs + number) * s.islands + row["island"]
                    out.append([p.astype(np.int32).tobytes() for p in evolve(np.array(row["sizes"], np.int64), old, s, seed)])
                yield pa.RecordBatch.from_arrays([batch["block"], batch["island"], pa.array(out, pa.list_(pa.binary()))], names=["block", "island", "people"])

        return run

    parallel = max(1, min(n_blocks * s.islands, 4 * items.sparkSession.sparkContext.defaultParallelism))
    for number in range(s.epochs):
        evolved = checkpointed(state.select("block", "island", "sizes", "people").repartition(parallel, "block", "island").mapInArrow(epoch(number), schema))
        if number + 1 < s.epochs:
            # the best of each island goes to the next one, in place of that one's worst
            elite = evolved.select("block", F.pmod(F.col("island") + 1, F.lit(s.islands)).alias("island"), F.slice("people", 1, 1).alias("elite"))
            mixed = evolved.join(elite, ["block", "island"]).select("block", "island", F.concat("elite", F.slice("people", 1, max(1, s.population - 1))).alias("people"))
            state = islands.join(mixed, ["block", "island"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array([h["length"] for h in row["held"]], np.int64)
                choice = max((np.frombuffer(p, np.int32) for p in row["packings"]), key=lambda p: fitness(sizes, p, s.capacity))
                fill = fills(sizes, choice)[choice]
                items = pa.array([h["item"] for h in row["held"]], pa.int64())
                yield pa.record_batch({"item": items, "length": pa.array(sizes), "bin": pa.array((row["block"] << 24) + choice.astype(np.int64)), "bin_fill": pa.array(fill)})

    best = evolved.groupBy("block").agg(F.sort_array(F.collect_list(F.get("people", 0))).alias("packings"))
    return packs.join(best, "block").mapInArrow(unpack, "item long, length long, bin long, bin_fill long")


def pack_pieces(pieces: DataFrame, s: Settings) -> DataFrame:
    """Add sequence_id and offset to pieces (with a ``length`` of at most the capacity)."""
    numbered = stage_table(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")  # the files fix the numbers
    items = numbered.where(F.col("length") < s.capacity).select("item", "length")
    placed, level, left = None, 1, items.count()
    while left:
        n_blocks = max(1, -(-left // s.block_items))
        packed = stage_table(pack_blocks(items, n_blocks, s, level), f"packed-{level}")
        ready = packed if n_blocks == 1 else packed.where(F.col("bin_fill") >= s.refill_below * s.capacity)
        ready = ready.select("item", ((F.lit(level).cast("long") * (1 << 56)) + F.col("bin")).alias("sequence_id"))
        placed = ready if placed is None else placed.unionByName(ready)
        if n_blocks == 1:
            break
        items = packed.where(F.col("bin_fill") < s.refill_below * s.capacity).select("item", "length")
        before, left, level = left, items.count(), level + 1
        if left > before // 2:  # hard to fill: keep the packing as it is
            placed = placed.unionByName(packed.where(F.col("bin_fill") < s.refill_below * s.capacity).select("item", (F.lit(level).cast("long") * (1 << 56) + F.col("bin")).alias("sequence_id")))
            break
    full = numbered.where(F.col("length") >= s.capacity).withColumn("sequence_id", F.col("item"))
    if placed is None:
        return full.withColumn("offset", F.lit(0).cast("long")).drop("item")
    from pyspark.sql import Window

    before_it = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    short = numbered.join(placed, "item").withColumn("offset", F.coalesce(F.sum("length").over(before_it), F.lit(0)))
    return short.unionByName(full.withColumn("offset", F.lit(0).cast("long"))).drop("item")


def pack_documents(docs: DataFrame, tokenizer: str, s: Settings = Settings()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack_pieces(cut_pieces(docs, tokenizer, s.capacity), s)
