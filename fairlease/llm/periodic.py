"""Periodic runs of words: seed-and-extend along the diagonals of a text against itself.

A run is a maximal stretch whose words ``q`` apart are equal, ``q`` its smallest period, at least
``max(least, cubes * q)`` words long.  Along the diagonal of lag ``q`` such a run is a stretch of
``length - q`` equal words, so two occurrences of any k-gram with ``k <= max(least - q, (cubes - 1) * q)``
lie ``q`` apart in it.  With the defaults lags below 16 are guaranteed a shared 16-gram, lags from
``k / 2`` to ``k - 1`` a shared k-gram for k = 32, 64, ...

*Index.* 16-grams are named by a hash salted with the document, 2k-grams exactly by the pair of
their halves' names; only grams that occur twice in their document go on, so most texts end at 16.
*Pairs.* Of a gram's occurrences at the lags of its class only the next one is paired.  If it occurs
at two such lags ``q1 < q2 <= k``, the gram has periods ``q1`` and ``q2 - q1``, hence their greatest
common divisor, which divides ``q2`` and is smaller: ``q2`` is no smallest period there.  So a class
makes at most one pair a position, whatever a text repeats.
*Extension.* Pairs come by lag and position.  The furthest position that the lag's extensions have
covered is kept; pairs inside it are skipped, so no word of a diagonal is compared twice.

Everything of a document is done in its task, without a shuffle.  Memory is a few arrays as long as the text has
words, time grows with words times the logarithm of the longest period.

Defined results: null text counts as empty, with no words, no runs and '' as collapsed text; words
are maximal runs of bytes other than the six ASCII white-space characters and compare by their bytes;
equal texts have equal runs; repeated rows and null doc_ids are kept as rows of their own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlease.llm.shared import BATCH_ROWS
from fairlease.llm.text import mix, sorted_unique

WHITE = r"[\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = 16
#: Words whose 16-grams are named at once: rows of a batch are worked on together up to here.
BLOCK_WORDS = 1 << 17


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated(names: np.ndarray) -> np.ndarray:
    """Mask of the names that occur more than once."""
    s = np.sort(names)
    twice = sorted_unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(twice, names), len(twice) - 1)
    return twice[at] == names


def seeds(numbers: np.ndarray) -> np.ndarray:
    """(lag, position) rows in order: for each gram class the next occurrence at a lag of the class."""
    n = len(numbers)
    if n <= _GRAM:
        return np.empty((0, 2), np.int64)
    values = mix(numbers.astype(np.uint64) + np.uint64(1))
    names = np.zeros(n - _GRAM + 1, np.uint64)
    for j in range(_GRAM):  # a polynomial of a window's values
        names = names * _STEP + values[j : n - _GRAM + 1 + j]
    places = np.flatnonzero(repeated(names))
    names = np.unique(names[places], return_inverse=True)[1]
    k, found = _GRAM, []
    while len(places):
        low = 1 if k == _GRAM else k // 2
        order = np.lexsort((places, names))
        p, g = places[order], names[order]
        key = g * (n + k) + p  # names are ranks, so this sorts like (name, position)
        after = np.searchsorted(key, key + low)
        inside = after < len(p)
        i, j = np.flatnonzero(inside), after[inside]
        near = (g[j] == g[i]) & (p[j] - p[i] < k)
        found.append(np.stack([p[j[near]] - p[i[near]], p[i[near]]], 1))
        # the next class: grams whose halves both go on
        rank = np.full(n + 1, -1, np.int64)
        rank[places] = names
        ahead = rank[np.minimum(places + k, n)]
        whole = ahead >= 0
        places, pair = places[whole], names[whole] * (n + 1) + ahead[whole]
        again = repeated(pair)
        places = places[again]
        names = np.unique(pair[again], return_inverse=True)[1]
        k *= 2
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix, compared in growing pieces."""
    done, step, n = 0, 64, min(len(a), len(b))
    while done < n:
        differ = np.flatnonzero(a[done : min(n, done + step)] != b[done : min(n, done + step)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return n


def runs(numbers: np.ndarray, least: int = 24, cubes: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period.

    ``least`` and ``cubes`` must keep the shared grams: ``least >= 24`` and ``cubes >= 3``.
    """
    if least < 24 or cubes < 3:
        raise ValueError("runs shorter than 24 words or three periods share no 16-gram for sure")
    spans: dict[tuple[int, int], int] = {}
    lag, covered = 0, 0
    for q, i in seeds(numbers).tolist():
        if q != lag:
            lag, covered = q, 0
        if i < covered:
            continue
        end = i + reach(numbers[i:-q], numbers[i + q :])
        start = i - reach(numbers[:i][::-1], numbers[q : i + q][::-1])
        covered = end + 1
        length = end - start + q
        # a stretch seen at a smaller lag is that run: lags come in ascending order
        if length >= max(least, cubes * q):
            spans.setdefault((start, length), q)
    return sorted((start, length, q) for (start, length), q in spans.items())


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] == 0


RUNS_TYPE = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, least: int = 24, cubes: int = 3) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period; by start, then period) and ``collapsed`` (kept words joined by one space)."""
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
        words = (text or "").encode().split()
        found = runs(word_numbers(words), least, cubes)
        if found:
            keep = kept_words(len(words), found)
            return len(words), found, b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode()
        return len(words), found, b" ".join(words).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                rows = [one(t.as_py()) for t in part.column(1)]
                found = [[{"start": s, "length": n, "period": q} for s, n, q in r[1]] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(found, arrow), pa.array([r[2] for r in rows], pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS_TYPE}, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """The query's input: one document in ten, by crc32 of its id, goes on periodically from one of its words.

    With h that checksum, g = floor(h / 10) and n words, each word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h.alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", WHITE), lambda w: w != "")))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    docs = docs.withColumns({"g": g, "n": n}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    left = F.col("n") - F.col("a")
    period = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    again = F.flatten(F.array_repeat(period, F.ceil(left / F.col("p")).cast("int")))
    planted = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), left.cast("int")))
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns of ``periodic_runs``: counts, the run of greatest exponent, checksums."""
    milli = lambda r: F.floor(r["length"] * 1000 / r["period"])

    def better(x: Column, y: Column) -> Column:  # by exact length / period, then smaller start, then smaller period
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return (left > right) | ((left == right) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] <= y["period"]))))

    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(better(x, y), x).otherwise(y))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli(F.col("best")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Digests of the runs of every document after the periods are planted."""
    return digests(periodic_runs(with_planted_period(docs)))
