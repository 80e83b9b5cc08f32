"""Removal of long repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``length`` bytes covers it that also starts earlier (smaller doc_id, or
earlier in the document).  Strings get names, and Spark brings equal names together; positions
whose name is unique leave, the rest get the names of longer strings until they are past the
threshold:

1. Every window of ``length`` bytes is named by its smallest gram of ``GRAM`` bytes.  Neighbouring
   windows mostly share it, so a run of windows is one position: about one in forty of all.
   Runs whose gram is unique leave.
2. The others are named by the whole text under the run.  Equal names mean equal windows all
   along: all but the earliest run are repeats.
3. Where one gram has several such names, the texts of each name's earliest run come together by
   gram, and their windows are looked at one by one, named by the pair of the names of their halves.

Names are 64-bit hashes, and two names must agree (gram and text, or both halves).  Grams found in
a large share of the documents skip to step 3, whose names are reduced inside each task first, so
no hot passage meets in one task.

Defined results: null text is empty; a text shorter than ``length`` keeps all its bytes; rows that
share a doc_id are ordered by start alone, equal rows get equal results; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlease.llm.shared import stage_table
from fairlease.llm.text import RollingHash, blocks, mix, release, sorted_counts

GRAM = 24
#: Share of the documents from which a gram is hot.
HOT_SHARE = 0.005
ROWS_PER_TASK = 250_000

#: Windows of a text that are worked on at once.
CHUNK = 1 << 22
#: Runs of one gram, of different text, that one task takes together.
MIXED_MAX = 20_000

RUN, WINDOW, REPEAT, MIXED, MIXED_WIDE, CONTEXT = range(6)
ROWS = "kind byte, deal long, name_a long, name_b long, doc_id long, tie int, start int, more int"


class Runs:
    """Runs of windows of a block that share their smallest gram."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.length = length
        n, span = len(data), length - GRAM + 1
        self.hash = RollingHash(data)
        self.gram = self.first = self.last = self.row = np.empty(0, np.int64)
        if n < length:
            return
        at = np.arange(n - GRAM + 1)
        h = self.hash.of(at, at + GRAM)
        bits = np.uint64(31)  # a place in any text; the same for all blocks, so that equal windows choose alike
        low = (h >> bits << bits) | at.astype(np.uint64)  # the leftmost of equal grams is smallest
        reach = 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if span > reach:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        sizes = np.diff(offsets)
        ends = np.repeat(offsets[1:], sizes)[: len(low)]
        windows = np.flatnonzero(np.arange(len(low)) + length <= ends)
        if not len(windows):
            return
        place = (low[windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        self.first = windows[new]
        self.last = windows[np.append(new[1:], len(windows)) - 1]
        self.gram = h[place[new]]
        self.row = np.searchsorted(offsets, self.first, "right") - 1
        self.shift = place[new] - self.first

    def names(self) -> np.ndarray:
        """A name of all text under a run, and of where the gram stands in it."""
        return mix(self.hash.of(self.first, self.last + self.length) + self.shift.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def parts(column: pa.Array, length: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row and place in its text of each part, bytes, offsets): blocks, with longer texts cut into parts
    of ``chunk`` windows.  Each window is in one part; a run that a cut divides is two runs."""
    for lo, hi, data, offsets in blocks(column):
        if hi - lo > 1 or len(data) <= chunk:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), data, offsets
            continue
        for place in range(0, max(1, len(data) - length + 1), chunk):
            part = data[place : place + chunk + length - 1]
            yield np.array([lo]), np.array([place]), part, np.array([0, len(part)])


def earliest(a: np.ndarray, b: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for the rows at the first place, by (doc, start), among rows of equal (a, b)."""
    key = mix(a ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)))
    order = np.argsort(key)
    new = key[order][1:] != key[order][:-1]
    same = np.flatnonzero(~new)
    if ((a[order[same]] != a[order[same + 1]]) | (b[order[same]] != b[order[same + 1]])).any():  # two pairs of one key
        order = np.lexsort((b, a))
        new = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.cumsum(np.concatenate([np.ones(min(1, len(key)), bool), new])) - 1
    several = np.bincount(group, minlength=1)[group] > 1 if len(key) else np.empty(0, bool)
    out = np.ones(len(key), bool)
    rows, group = order[several], group[several]
    if len(rows):
        by = np.lexsort((start[rows], doc[rows], group))
        rows, group = rows[by], group[by]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        head = rows[np.repeat(heads, np.diff(np.append(heads, len(rows))))]
        out[rows] = (doc[rows] == doc[head]) & (start[rows] == start[head])
    return out


def _rows(kind: int, deal, a, b, doc, tie, start, more) -> pa.RecordBatch:
    signed = lambda x: pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))
    return pa.record_batch({
        "kind": pa.array(np.full(len(doc), kind, np.int8)), "deal": signed(deal), "name_a": signed(a), "name_b": signed(b),
        "doc_id": pa.array(doc.astype(np.int64)), "tie": pa.array(tie.astype(np.int32)), "start": pa.array(start.astype(np.int32)), "more": pa.array(more.astype(np.int32)),
    })


def _send(kind: int, a, b, doc, tie, start, more) -> Iterator[pa.RecordBatch]:
    """The earliest row of each name; the others are settled as repeats on the spot."""
    first = earliest(a, b, doc, start)
    deal, a = (a, np.zeros_like(a)) if kind == RUN else (mix(a + b), a)  # a run is dealt by its gram, which need not travel twice
    yield _rows(kind, deal[first], a[first], b[first], doc[first], tie[first], start[first], more[first])
    if not first.all():
        yield _repeats(doc[~first], tie[~first], start[~first], more[~first])


def _repeats(doc, tie, start, more) -> pa.RecordBatch:
    none = np.zeros(len(doc), np.uint64)
    return _rows(REPEAT, mix(doc.astype(np.int64).view(np.uint64)), none, none, doc, tie, start, more)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)).astype(np.int32)


def keyed(docs: DataFrame, unique: bool, *more: F.Column) -> DataFrame:
    """doc_id (the smallest number for null), tie (tells texts of one doc_id apart, 0 if ids are unique), text, ``more``."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
        (F.lit(0) if unique else F.shiftright(F.xxhash64("text"), 32).cast("int")).alias("tie"),
        F.coalesce("text", F.lit("")).alias("text"),
        *more,
    )


def hot_grams(texts: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """(grams that at least ``HOT_SHARE`` of the documents of some batch hold, number of runs)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, runs = [], 0
            for _, _, data, offsets in parts(batch.column(0), length, CHUNK):
                found = Runs(data, offsets, length)
                runs += len(found.gram)
                if len(found.gram):
                    # once a document: equal grams of one row stand together after the sort
                    by = np.lexsort((found.gram, found.row))
                    g, r = found.gram[by], found.row[by]
                    grams.append(g[np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])])
            gram, n = sorted_counts(np.concatenate(grams)) if grams else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = n >= max(32, HOT_SHARE * batch.num_rows)
            yield pa.record_batch({"gram": pa.array(np.append(gram[often].view(np.int64), 0)), "n": pa.array(np.append(n[often], 0)), "runs": pa.array(np.append(np.zeros(int(often.sum()), np.int64), runs))})

    total = texts.count()
    counted = stage_table(texts.select("text").mapInArrow(count, "gram long, n long, runs long"), "grams")
    runs = counted.agg(F.sum("runs")).collect()[0][0] or 0
    often = counted.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(32, HOT_SHARE / 2 * total))
    # at most 2 / HOT_SHARE times the runs of a mean document
    return np.sort(np.array([r["gram"] for r in often.select("gram").collect()], np.int64).view(np.uint64)), runs


def _in_sorted(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return values[at] == x


def _windows(found: Runs | RollingHash, doc, tie, row, begin, first, more, length: int) -> Iterator[pa.RecordBatch]:
    """Rows of the single windows of runs (block positions ``first``, ``more`` windows after it)."""
    many = more + 1
    at = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    middle = at + length // 2
    row = np.repeat(row, many)
    yield from _send(WINDOW, found.of(at, middle), found.of(middle, at + length), doc[row], tie[row], at - begin[row], np.zeros(len(at), np.int32))


def _settle(length: int):
    """What one task of the exchange decides: repeats, and the runs to look at window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        kind = held["kind"].to_numpy()
        for k in (RUN, WINDOW, REPEAT):
            part = held.filter(pa.array(kind == k))
            if not part.num_rows:
                continue
            a, b = (part[c].to_numpy().view(np.uint64) for c in ("deal" if k == RUN else "name_a", "name_b"))
            doc, tie, start, more = (part[c].to_numpy() for c in ("doc_id", "tie", "start", "more"))
            if k == REPEAT:
                yield _repeats(doc, tie, start, more)
                continue
            first = earliest(a, b, doc, start)
            if not first.all():
                yield _repeats(doc[~first], tie[~first], start[~first], more[~first])
            if k == RUN:
                order = np.lexsort((b[first], a[first]))
                at = np.flatnonzero(first)[order]
                x, y = a[at], b[at]
                if len(at) < 2:
                    continue
                new_a = np.concatenate([[True], x[1:] != x[:-1]])
                group = np.cumsum(new_a) - 1
                names = np.bincount(group, new_a | np.concatenate([[True], y[1:] != y[:-1]]))[group]
                for wide in (False, True):
                    some = at[(names > 1) & ((names > MIXED_MAX) == wide)]
                    none = np.zeros(len(some), np.uint64)
                    yield _rows(MIXED_WIDE if wide else MIXED, a[some], none, none, doc[some], tie[some], start[some], more[some])
        release()

    return run


def _compare(length: int):
    """Repeated windows among the texts of runs that share a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        gram = held["deal"].to_numpy()
        doc, tie, start, more = (held[c].to_numpy() for c in ("doc_id", "tie", "start", "more"))
        context = held["context"].combine_chunks()
        order = np.argsort(gram, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
        # whole grams at a time, up to some number of windows
        windows = np.add.reduceat(more[order].astype(np.int64) + 1, heads)
        slab = np.cumsum(windows) // 500_000
        cuts = np.flatnonzero(np.concatenate([[True], slab[1:] != slab[:-1]]))
        for lo, hi in zip(heads[cuts], np.append(heads[cuts[1:]], len(order)), strict=True):
            at = order[lo:hi]
            texts = context.take(pa.array(at))
            size = more[at].astype(np.int64) + length
            begin = np.cumsum(size) - size
            many = more[at].astype(np.int64) + 1
            within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            place = np.repeat(begin, many) + within
            owner = np.repeat(np.arange(len(at)), many)
            hashes = RollingHash(np.frombuffer(b"".join(texts.to_pylist()), np.uint8))
            middle = place + length // 2
            again = ~earliest(hashes.of(place, middle), hashes.of(middle, place + length), doc[at][owner], start[at][owner] + within)
            opens = again.copy()
            opens[1:] &= ~again[:-1] | (owner[1:] != owner[:-1])
            shuts = again.copy()
            shuts[:-1] &= ~again[1:] | (owner[1:] != owner[:-1])
            a, z = np.flatnonzero(opens), np.flatnonzero(shuts)
            own = at[owner[a]]
            yield _repeats(doc[own], tie[own], start[own] + within[a], z - a)
        release()

    return run


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, tie, start, more): windows ``start`` to ``start + more`` of ``keyed`` documents also start earlier."""
    spark = docs.sparkSession
    hot, runs = hot_grams(docs, length)
    sent = spark.sparkContext.broadcast(hot)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-runs // ROWS_PER_TASK))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = _keys(batch)
            cold = []
            for rows, places, data, offsets in parts(batch.column(2), length, CHUNK):
                found = Runs(data, offsets, length)
                if not len(found.gram):
                    continue
                is_hot = _in_sorted(found.gram, sent.value)
                row, more = rows[found.row], found.last - found.first
                begin = np.zeros(len(doc), np.int64)
                begin[rows] = offsets[:-1] - places
                if is_hot.any():
                    yield from _windows(found.hash, doc, tie, row[is_hot], begin, found.first[is_hot], more[is_hot], length)
                c = ~is_hot
                cold.append((found.gram[c], found.names()[c], doc[row[c]], tie[row[c]], (found.first - begin[row])[c], more[c]))
            if cold:
                yield from _send(RUN, *(np.concatenate(x) for x in zip(*cold, strict=True)))

    out = ["kind", "deal", "doc_id", "tie", "start", "more"]
    settled = stage_table(docs.mapInArrow(emit, ROWS).repartition(tasks, "deal").mapInArrow(_settle(length), ROWS).select(*out), "runs")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = _keys(batch)
            spans = batch.column(3)
            size = np.diff(np.asarray(spans.offsets))
            flat = spans.flatten()
            start, more, gram, kind = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "more", "deal", "kind"))
            cut = np.concatenate([[0], np.cumsum(size)])
            for lo, hi, data, offsets in blocks(batch.column(2)):
                begin = np.zeros(len(doc), np.int64)
                begin[lo:hi] = offsets[:-1]
                own = slice(cut[lo], cut[hi])
                row = np.repeat(np.arange(lo, hi), size[lo:hi])
                at = begin[row] + start[own]
                wide = kind[own] == MIXED_WIDE
                if wide.any():
                    for rows in _windows(RollingHash(data), doc, tie, row[wide], begin, at[wide], more[own][wide], length):
                        yield rows.append_column("context", pa.nulls(rows.num_rows, pa.binary()))
                if not wide.all():
                    w = ~wide
                    raw = data.tobytes()
                    texts = [raw[a:b] for a, b in zip(at[w], at[w] + more[own][w] + length, strict=True)]
                    none = np.zeros(int(w.sum()), np.uint64)
                    rows = _rows(CONTEXT, gram[own][w].view(np.uint64), none, none, doc[row[w]], tie[row[w]], start[own][w], more[own][w])
                    yield rows.append_column("context", pa.array(texts, pa.binary()))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        context = [np.asarray(b.column(0)) == CONTEXT for b in rows]
        yield from _compare(length)(iter([b.filter(pa.array(c)) for b, c in zip(rows, context, strict=True)]))
        yield from _settle(length)(iter([b.filter(pa.array(~c)).drop_columns(["context"]) for b, c in zip(rows, context, strict=True)]))

    spans = F.collect_list(F.struct("start", "more", "deal", F.col("kind").cast("int").alias("kind"))).alias("spans")
    mixed = settled.where(F.col("kind").isin(MIXED, MIXED_WIDE)).groupBy("doc_id", "tie").agg(spans)
    looked = docs.join(mixed, ["doc_id", "tie"]).select("doc_id", "tie", "text", "spans").mapInArrow(look, ROWS + ", context binary")
    compared = stage_table(looked.repartition(tasks, "deal").mapInArrow(last, ROWS).select(*out), "compared")
    return settled.unionByName(compared).where(F.col("kind") == REPEAT).select("doc_id", "tie", "start", "more")


def covered(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, more: np.ndarray, length: int) -> np.ndarray:
    """True for the bytes of a block under the windows."""
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, offsets[row] + start, np.int32(1))
    np.add.at(change, offsets[row] + start + more + length, np.int32(-1))
    return np.cumsum(change, dtype=np.int32)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = 100, with_rows: bool = False) -> DataFrame:
    """Per document n_bytes, n_removed, n_spans, kept_sha256.

    ``with_rows`` adds the whole input row (struct ``row``) and the bytes that stay (``kept``).
    """
    ids = docs.select("doc_id")
    unique = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0
    found = repeated_windows(keyed(docs, unique), length).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "more")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(3)
            size = np.diff(np.asarray(spans.offsets))
            flat = spans.flatten()
            start, more = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "more"))
            at = np.concatenate([[0], np.cumsum(size)])
            n_bytes, removed, runs, digest, texts_left = [], [], [], [], []
            for lo, hi, data, offsets in blocks(batch.column(2)):
                own = slice(at[lo], at[hi])
                gone = covered(data, offsets, np.repeat(np.arange(hi - lo), size[lo:hi]), start[own], more[own], length)
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                heads = offsets[:-1][offsets[:-1] < len(data)]
                opens[heads] = gone[heads]
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])  # noqa: B023, E731
                n_bytes.append(np.diff(offsets))
                removed.append(sums(gone))
                runs.append(sums(opens))
                kept = data[~gone].tobytes()
                ends = np.cumsum(np.diff(offsets) - removed[-1])
                for a, b in zip(ends - (np.diff(offsets) - removed[-1]), ends, strict=True):
                    digest.append(hashlib.sha256(kept[a:b]).hexdigest())
                    if with_rows:
                        texts_left.append(kept[a:b])
            columns = {"doc_id": batch.column(0), "tie": batch.column(1)}
            for name, x in (("n_bytes", n_bytes), ("n_removed", removed), ("n_spans", runs)):
                columns[name] = pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64())
            columns["kept_sha256"] = pa.array(digest, pa.string())
            if with_rows:
                columns |= {"row": batch.column(4), "kept": pa.array(texts_left, pa.binary())}
            yield pa.record_batch(columns)

    rows = [F.struct("*").alias("row")] if with_rows else []
    none = F.array().cast("array<struct<start:int,more:int>>")
    joined = keyed(docs, unique, *rows).join(found, ["doc_id", "tie"], "left").select("doc_id", "tie", "text", F.coalesce("spans", none).alias("spans"), *(["row"] if with_rows else []))
    schema = T.StructType().add("doc_id", "long").add("tie", "integer").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_rows:
        schema = schema.add("row", joined.schema["row"].dataType).add("kept", T.BinaryType())
    out = joined.mapInArrow(cut, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def cleaned_rows(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; null text stays null, a character cut in two goes whole."""
    done = remove_repeats(docs, length, with_rows=True)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if k is None else k.decode("utf-8", "ignore") for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "left"])

    schema = T.StructType([done.schema["row"], T.StructField("left", T.StringType())])
    # untouched texts need no decoding
    kept = F.when(F.col("n_removed") > 0, F.col("kept"))
    rows = done.select("row", kept.alias("kept")).mapInArrow(decode, schema)
    return rows.select(*[F.coalesce("left", F.col("row")["text"]).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def removed_documents(docs: DataFrame, length: int = 100) -> DataFrame:
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
