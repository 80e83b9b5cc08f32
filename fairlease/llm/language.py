"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent byte n-grams (1 to 4 bytes, within lower-cased words
that are marked at both ends), most frequent first.  A document's profile is compared with each
language's by the out-of-place distance: the sum over the document's n-grams of how far apart the
two ranks are, the profile length where the language lacks the n-gram.  The nearest language wins.

Defined results: null text and text without a letter are ``und`` with score 0, as is everything
when nothing was learned; distance ties go to the language first in alphabetical order; repeated
rows are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlease.llm.text import blocks, sorted_counts

MAX_N = 4
_MARK = 95  # "_" stands for any run of what is no letter


def _letters() -> np.ndarray:
    """Byte to itself for ASCII letters and non-ASCII bytes, to the mark for the rest."""
    to = np.full(256, _MARK, np.uint8)
    for a, b in ((65, 91), (97, 123), (128, 256)):
        to[a:b] = np.arange(a, b)
    return to


LETTERS = _letters()


@dataclass(frozen=True)
class Settings:
    profile: int = 400  # n-grams of a profile
    max_docs: int = 8_000  # bound of the training sample of a language, in expectation


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram as a little-endian number, count) of a block of texts, in row order."""
    # a mark before each text, between words (once) and at the end
    put = np.empty(len(data) + len(offsets), np.uint8)
    put[offsets + np.arange(len(offsets))] = _MARK
    inner = np.ones(len(put), bool)
    inner[offsets + np.arange(len(offsets))] = False
    put[inner] = LETTERS[data]
    row = np.repeat(np.arange(len(offsets), dtype=np.uint64), np.append(np.diff(offsets) + 1, 1))
    kept = np.ones(len(put), bool)
    kept[1:] = ~((put[1:] == _MARK) & (put[:-1] == _MARK) & (row[1:] == row[:-1]))
    put, row = put[kept], row[kept]
    # an n-gram that would run into the next text, or over a word's end, is none
    codes = put.astype(np.uint64)
    word = np.cumsum(put == _MARK)
    found, rows = [codes[put != _MARK]], [row[put != _MARK]]
    grown = codes
    for n in range(2, MAX_N + 1):
        if len(put) < n:
            break
        grown = grown[: len(put) - n + 1] | (codes[n - 1 :] << np.uint64(8 * (n - 1)))
        first, last = slice(0, len(put) - n + 1), slice(n - 1, None)
        # marks inside: none beyond one at the start and one at the end; the next text's mark may close the last word
        marks = word[last] - word[first] - (put[last] == _MARK)
        here = (marks == 0) & ~((put[first] == _MARK) & (put[last] == _MARK) & (n == 2))
        found.append(grown[here])
        rows.append(row[first][here])
    keys, counts = sorted_counts((np.concatenate(rows) << np.uint64(32)) | np.concatenate(found))
    return (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF), counts


def ranked(row: np.ndarray, code: np.ndarray, counts: np.ndarray, rows: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, rank from 0) of each row's ``top`` most frequent n-grams; ties to the smaller number."""
    cuts = np.searchsorted(row, np.arange(rows + 1))
    within = np.arange(len(row)) - cuts[row]
    bits = max(1, int(within.max(initial=0)).bit_length())
    most = int(counts.max(initial=0))
    order = (most - counts).astype(np.uint64) << np.uint64(bits) | within.astype(np.uint64)
    key = (row.astype(np.uint64) << np.uint64(bits + max(1, most.bit_length()))) | order
    at = np.sort(key) & np.uint64((1 << bits) - 1)  # row order stays, so positions below are row by row
    rank = np.arange(len(row)) - cuts[row]
    keep = rank < top
    return row[keep], code[(cuts[row] + at.astype(np.int64))[keep]], rank[keep]


def learn_profiles(docs: DataFrame, s: Settings) -> dict[str, list[int]]:
    """Language to its n-grams, most frequent first, from rows (doc_id, text, lang).

    Of a language with more than ``max_docs`` documents a hash of doc_id picks about that many.
    """
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return {}
    pick = F.lit(False)
    u = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    for lang, n in sorted(sizes.items()):
        pick = F.when(F.col("lang") == lang, u < int((1 << 30) * min(1.0, s.max_docs / n))).otherwise(pick)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == lang))
                for _, _, data, offsets in blocks(texts):
                    _, code, n = ngram_counts(data, offsets)
                    order = np.argsort(code, kind="stable")
                    code, n = code[order], n[order]
                    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
                    if len(first):
                        yield pa.record_batch({"lang": pa.array([lang] * len(first), pa.string()), "gram": pa.array(code[first].astype(np.int64)), "n": pa.array(np.add.reduceat(n, first).astype(np.int64))})

    grams = known.where(pick).select("lang", F.lower("text").alias("text")).mapInArrow(count, "lang string, gram long, n long")
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.profile)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):  # at most ``profile`` rows a language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str], s: Settings) -> DataFrame:
    """``docs`` columns ``keep`` plus lang_pred and score (1 - mean out-of-place distance of the nearest profile)."""
    langs = sorted(profiles)
    grams = np.array(sorted({g for p in profiles.values() for g in p}), np.uint64)
    place = np.full((len(grams) + 1, max(1, len(langs))), -1, np.int32)
    for j, lang in enumerate(langs):
        place[np.searchsorted(grams, np.array(profiles[lang], np.uint64)), j] = np.arange(len(profiles[lang]))
    sent = docs.sparkSession.sparkContext.broadcast((langs, grams, place))  # languages x profile numbers
    top = s.profile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, grams, place = sent.value
        for batch in batches:
            *kept, lettered, texts = batch.columns
            best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            if langs:
                for lo, hi, data, offsets in blocks(texts):
                    row, code, rank = ranked(*ngram_counts(data, offsets), hi - lo, top)
                    at = np.searchsorted(grams, code)
                    at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != code)] = len(grams)
                    n = np.maximum(np.bincount(row, minlength=hi - lo), 1)
                    far = np.empty((hi - lo, len(langs)))
                    for j in range(len(langs)):
                        p = place[at, j]
                        off = np.where(p < 0, top, np.abs(p - rank))
                        far[:, j] = np.bincount(row, off, minlength=hi - lo) / (n * top)
                    best[lo:hi] = far.argmin(1)
                    score[lo:hi] = 1 - far.min(1)
            known = np.asarray(lettered.to_pylist(), bool) & bool(langs)
            name = [langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(name, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*batch.schema.names[:-2], "lang_pred", "score"])

    rows = docs.select(*keep, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__lettered"), F.lower("text").alias("__lowered"))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, *added]))


def identify_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; held-out rows teach nothing."""
    from fairlease.llm.toxicity import held_out

    learn = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    scored = predict(docs.select("doc_id", "text"), learn_profiles(learn, s), ["doc_id"], s)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
