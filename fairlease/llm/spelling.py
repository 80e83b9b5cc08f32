"""Spelling variants: words one edit apart, found by probing edits against Bloom filters.

*Vocabulary.* Runs of letters are counted; words long and frequent enough get ids in order of
descending count, then code points, so the best of several words is the smallest id.
*Filters.* Words of each length make a filter shard: blocks of 64 bits, ``BITS_PER_WORD`` bits a
word, four bits set in one block.  The shards are broadcast as one array of at most ``PASS_BYTES``;
a larger vocabulary is dealt by hash over several passes, each with its own filters.
*Probes.* Tasks make every word's edits as hashes, in bulk: each replacement by a later letter of
the alphabet, probed in the word's own shard, and each deletion, probed in the shard of the shorter
words.  That covers every pair once: an insertion is the other word's deletion.
*Join.* Only edits that a filter lets through become strings and are shuffled to an exact join
with the vocabulary, which removes the false positives.  Edits of words over ``LONG`` code points
travel as 128-bit names and their joined pairs are compared letter by letter.

A word has at most about 180 neighbours a code point, so no key of the pair tables can grow with
the corpus.  A form is at least ten times as frequent as its word, so a chain of forms has at most
19 steps (counts are longs); roots are found by doubling pointers in at most five rounds.

Defined results: null text has no words; a null doc_id counts as '' where the deletion is chosen; a
run of one letter whose letter is deleted is no word; equal rows count as often as they come;
ties of the form go to the smallest word in code-point order; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_lowercase
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlease.llm.shared import BATCH_ROWS, stage_table
from fairlease.llm.text import byte_codes, mix

#: All letters a word can hold, by code point; each fits a Latin-1 byte.
ALPHABET = np.frombuffer((ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))).encode("latin-1"), np.uint8)
BITS_PER_WORD = 24
PASS_BYTES = 32 << 20
#: Words of this length and longer share a filter shard; longer ones than this go by name into the join.
LONG = 64
WORDS_PER_TASK = 16_384
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
#: Edits made at once.
_CHUNK = 1 << 17


@lru_cache(maxsize=64)
def _powers(n: int) -> np.ndarray:
    up = np.full(n, _BASE, np.uint64)
    up[:1] = 1
    return np.cumprod(up, dtype=np.uint64)


def _terms(words: np.ndarray, seed: int) -> np.ndarray:
    """What each letter of (n, length) words adds to its word's raw hash."""
    return byte_codes(seed)[words] * _powers(words.shape[1])


class Layout:
    """Places of the filter shards in one array of 64-bit blocks, for one of ``passes``."""

    def __init__(self, words_by_shard: dict[int, int], passes: int):
        self.passes = passes
        self.blocks = np.zeros(LONG + 1, np.uint64)
        for shard, n in words_by_shard.items():
            self.blocks[shard] = -(-n * BITS_PER_WORD // (64 * passes))
        self.starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.blocks, dtype=np.uint64)])

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    def place(self, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pass, block, mask) of raw hashes of words of one length."""
        x = mix(raw + np.uint64(length))
        shard = min(length, LONG)
        block = self.starts[shard] + (((x >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32))
        one, six = np.uint64(1), np.uint64(63)
        mask = (one << (x & six)) | (one << ((x >> np.uint64(6)) & six)) | (one << ((x >> np.uint64(12)) & six)) | (one << ((x >> np.uint64(18)) & six))
        turn = np.zeros(len(x), np.uint64) if self.passes == 1 else ((mix(x) >> np.uint64(32)) * np.uint64(self.passes)) >> np.uint64(32)
        return turn, block, mask


def by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, letters as an (n, length) byte matrix) of a column of words."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, np.frombuffer(b"".join(raw[r] for r in rows), np.uint8).reshape(len(rows), length)


def _long_names(first: np.ndarray, second: np.ndarray, length: int) -> list[str]:
    a, b = mix(first), mix(second)
    return [f"{length}#{x:016x}{y:016x}" for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def join_keys(words: np.ndarray) -> list[str]:
    """The words, or the 128-bit names of long ones."""
    n, length = words.shape
    if length > LONG:
        return _long_names(_terms(words, 2).sum(1, dtype=np.uint64), _terms(words, 3).sum(1, dtype=np.uint64), length)
    raw = words.tobytes().decode("latin-1")
    return [raw[i * length : (i + 1) * length] for i in range(n)]


def _passing(layout: Layout, filters: np.ndarray, turn: int, raw: np.ndarray, length: int) -> np.ndarray:
    """Positions of the raw hashes that the pass's filters may hold."""
    if not layout.blocks[min(length, LONG)]:
        return np.empty(0, np.int64)
    own, block, mask = layout.place(raw, length)
    held = (filters[block] & mask) == mask
    return np.flatnonzero(held if layout.passes == 1 else held & (own == turn))


def passing_edits(words: np.ndarray, layout: Layout, filters: np.ndarray, turn: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, join keys) of the edits of equally long words that the filters let through."""
    n, length = words.shape
    if n > 1 and n * length > _CHUNK:
        step = max(1, _CHUNK // length)
        for at in range(0, n, step):
            for rows, keys in passing_edits(words[at : at + step], layout, filters, turn):
                yield rows + at, keys
        return
    codes, powers = byte_codes(1), _powers(length)
    terms = _terms(words, 1)
    whole = terms.sum(1, dtype=np.uint64)
    width = max(1, _CHUNK // (n * len(ALPHABET)))
    for at in range(0, length, width):  # replacements at positions at .. at + width
        part = words[:, at : at + width]
        later = ALPHABET > part[:, :, None]
        raw = ((whole[:, None] - terms[:, at : at + width])[:, :, None] + codes[ALPHABET] * powers[at : at + width][:, None])[later]
        hits = _passing(layout, filters, turn, raw, length)
        if len(hits):
            rows, places, letters = (x[hits] for x in np.nonzero(later))
            yield rows, _edit_keys(words, rows, places + at, ALPHABET[letters])
    if length < 2:
        return
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
    raw = before[:, :-1] + (whole[:, None] - before[:, 1:]) * _INVERSE
    last = np.ones(words.shape, bool)  # of equal letters in a row only the last is deleted
    last[:, :-1] = words[:, :-1] != words[:, 1:]
    hits = _passing(layout, filters, turn, raw[last], length - 1)
    if len(hits):
        rows, places = (x[hits] for x in np.nonzero(last))
        yield rows, _edit_keys(words, rows, places, None)


def _edit_keys(words: np.ndarray, rows: np.ndarray, places: np.ndarray, letters: np.ndarray | None) -> list[str]:
    """Join keys of the words ``rows`` with the letters at ``places`` replaced, or deleted where ``letters`` is None."""
    out, length = [], words.shape[1]
    step = max(1, (1 << 22) // length)  # whole edited words at once
    for i in range(0, len(rows), step):
        r, p = rows[i : i + step], places[i : i + step]
        made = words[r]
        if letters is None:
            stay = np.ones(made.shape, bool)
            stay[np.arange(len(r)), p] = False
            made = made[stay].reshape(len(r), length - 1)
        else:
            made[np.arange(len(r)), p] = letters[i : i + step]
        out += join_keys(made)
    return out


def count_words(docs: DataFrame, least_length: int, least_count: int, delete_every: int) -> DataFrame:
    """(word, n): lower-cased letter runs, one letter deleted where ``delete_every`` divides the run's checksum.

    Tasks count the words of each Arrow batch, Spark adds the counts.
    """
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")  # the runs that are long enough, each of them whole

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                n: Counter[str] = Counter()
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    begun = crc32(f"{doc_id or ''}:".encode())
                    for run in pattern.findall((text.as_py() or "").encode().lower().decode()):  # bytes lower A-Z alone
                        h = crc32(run.encode(), begun)
                        if h % delete_every:
                            n[run] += 1
                        elif len(run) > least_length:
                            cut = h % len(run)
                            n[run[:cut] + run[cut + 1 :]] += 1
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    counts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def vocabulary(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, word, n), whose ids ascend with descending count, then with the word; and (id, key), what edits are joined by."""
    ranked = stage_table(counts.orderBy(F.col("n").desc(), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, words in by_length(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(join_keys(words), pa.string())], names=["id", "key"])

    short = ranked.where(F.length("word") <= LONG).select("id", F.col("word").alias("key"))
    names = ranked.where(F.length("word") > LONG).select("id", "word").mapInArrow(named, "id long, key string")
    return ranked, short.unionByName(names)


def _filters(words: DataFrame, layout: Layout, turn: int) -> np.ndarray:
    """The filter blocks of one pass (at most ``PASS_BYTES``, rounding aside), built by tasks and merged by Spark."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, letters in by_length(batch.column(0)):
                own, block, mask = layout.place(_terms(letters, 1).sum(1, dtype=np.uint64), length)
                here = own == turn
                yield pa.RecordBatch.from_arrays([pa.array(block[here].astype(np.int64)), pa.array(mask[here].view(np.int64))], names=["block", "mask"])

    merged = words.select("word").mapInArrow(placed, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(max(1, layout.size), np.uint64)
    out[merged["block"].to_numpy()] = merged["mask"].to_numpy().view(np.uint64)
    return out


def neighbours(words: DataFrame, keys: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(a, b): ids of all pairs of words one inserted, deleted or replaced code point apart, each pair once."""
    spark = words.sparkSession
    shards = {r["shard"]: r["n"] for r in words.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shards.values())
    passes = max(1, -(-total * BITS_PER_WORD // (8 * pass_bytes)))
    layout = Layout(shards, passes)
    tasks = max(1, -(-total // WORDS_PER_TASK))
    spread = words.select("id", "word").repartition(tasks, "id")
    positives = []
    for turn in range(passes):
        held = spark.sparkContext.broadcast(_filters(words, layout, turn))

        def probe(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for _, rows, letters in by_length(batch.column(1)):
                    for hit, edits in passing_edits(letters, layout, held.value, turn):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[hit]]), pa.array(edits, pa.string())], names=["a", "key"])

        positives.append(stage_table(spread.mapInArrow(probe, "a long, key string"), f"spelling-edits-{turn}"))
        held.destroy()
    edits = positives[0]
    for more in positives[1:]:
        edits = edits.unionByName(more)
    pairs = edits.join(keys.withColumnRenamed("id", "b"), "key")
    short = pairs.where(~F.col("key").contains("#")).select("a", "b")
    long = pairs.where(F.col("key").contains("#")).select("a", "b")
    texts = words.where(F.length("word") >= LONG)
    both = long.join(texts.select(F.col("id").alias("a"), F.col("word").alias("left")), "a").join(texts.select(F.col("id").alias("b"), F.col("word").alias("right")), "b")
    return short.unionByName(both.where(F.levenshtein("left", "right", 1) == 1).select("a", "b"))


def roots(up: DataFrame) -> DataFrame:
    """(id, root) of (id, form): pointers doubled until every one ends at a word without a form."""
    pointers = stage_table(up.select("id", F.col("form").alias("root")), "spelling-pointers")
    while True:
        ahead = pointers.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = pointers.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        pointers = stage_table(step, "spelling-pointers")
        if not pointers.where("moved").limit(1).count():
            return pointers.select("id", "root")
        pointers = pointers.select("id", "root")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, delete_every: int = 31, ratio: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of ``docs``."""
    words, keys = vocabulary(count_words(docs, least_length, least_count, delete_every))
    pairs = neighbours(words, keys, pass_bytes)
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near")))).alias("w")).select("w.*")
    near = ways.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("form"))
    best = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    known = words.join(near, "id", "left").join(best, "form", "left")
    frequent = F.coalesce(F.col("form_n") >= F.lit(ratio) * F.col("n"), F.lit(False))
    known = stage_table(
        known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(frequent, F.col(c)).alias(c) for c in ("form", "form_word", "form_n")]),
        "spelling-forms",
    )
    ends = roots(known.where("form is not null").select("id", "form"))
    last = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return known.join(last, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), F.col("n").cast("long").alias("n"), "n_near", F.col("form_n").cast("long").alias("form_n")
    )
