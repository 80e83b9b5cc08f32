"""Exact Jaccard join of word-shingle sets in their metric space: pivots and windows.

1 - Jaccard similarity is a metric, and two sets link at a distance of at most ``eps``.

* Equal sets are one point.  Points are brought together by rare shingles: with a fixed order of
  all shingles (rarest first, by a hashed count of the corpus), linked sets share one among their
  first ``n - ceil(t n) + 1``, so this loses no link; sizes and places rule out more pairs.
* Of the points that meet at a shingle the most typical one is the pivot, and its region takes in
  all of them.  Over the whole space Voronoi cells would be of no use (nearly all texts are at
  distance 1 from any pivot); a region holds what could be near its pivot's neighbours, and a
  point at the boundary of several is replicated into each.
* In a region, points within ``eps`` of the pivot are linked to it.  Each point of the rest is a
  pivot of its own in turn, over the points that the triangle inequality leaves: those whose
  distance from the first pivot differs by at most ``eps`` and that are not connected with it yet.
* A region too large for a task is cut: its points are measured against the pivot, the near ones
  linked, and each of the others then meets all points in windows of the distance to the pivot.

Components come from the links by rounds of minimum labels with pointer jumping.

Defined results: null, empty and wordless texts have no shingle and are components of their own;
fewer words than a shingle are one shingle; equal rows share everything; rows of one doc_id are
told apart by their sets; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fairlease.llm.shared import checkpointed, stage_table
from fairlease.llm.text import RollingHash, blocks, mix, release, sorted_unique, word_spans

WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TERMS = [np.uint64(x) for x in (0x9E6C63D0676A9A99, 0x82A2B175229D6A5B, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)]
POST, DOC, MEMBER = 0, 1, 2
CHUNKS = 16


@dataclass(frozen=True)
class Settings:
    width: int = 5
    num: int = 75  # sets link when den * intersection >= num * union
    den: int = 100
    region_max: int = 2048  # points that one task takes of a region
    rows_per_task: int = 250_000


def shingle_rows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of a block of texts in row order, repeats included."""
    starts, ends, before = word_spans(data, offsets, WHITE)
    h = RollingHash(LOWER[data]).of(starts, ends)
    words = np.diff(before)
    terms = np.resize(np.array(_TERMS, np.uint64), width) + np.arange(width, dtype=np.uint64) // np.uint64(len(_TERMS)) * np.uint64(2)
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        total += h[k : k + len(total)] * terms[k]
    row_of = np.repeat(np.arange(len(words)), words)
    whole = row_of[: len(total)] == row_of[width - 1 :] if len(total) else np.empty(0, bool)
    row, shingle = row_of[: len(total)][whole], mix(total[whole])
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = words[short] > k
            own[has] += h[before[short[has]] + k] * (terms[k] ^ words[short[has]].astype(np.uint64))
        row, shingle = np.concatenate([row, short]), np.concatenate([shingle, mix(own)])
        order = np.argsort(row, kind="stable")
        row, shingle = row[order], shingle[order]
    return row, shingle


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for lo, hi, data, offsets in blocks(column):
        row, shingle = shingle_rows(data, offsets, width)
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield sorted_unique(shingle[a:b])


def prefix_length(n: int, s: Settings) -> int:
    return n - -(-s.num * n // s.den) + 1


def rarity(texts: DataFrame, s: Settings) -> np.ndarray:
    """How often the shingles of each hash bucket come, over all texts; 16 bits a bucket, at most 2 ** 24 of them."""
    size = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    bits = int(min(24, max(16, np.ceil(np.log2(max(1, size) / 64)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                _, shingle = shingle_rows(data, offsets, s.width)
                np.add.at(held, (shingle >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        parts = np.minimum(held, 65535).astype(np.uint16).reshape(CHUNKS, -1)
        yield pa.record_batch({"chunk": pa.array(range(CHUNKS), pa.int32()), "counts": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // CHUNKS, np.uint64)
        for c in part["counts"]:
            total += np.frombuffer(zlib.decompress(c.as_py()), np.uint16)
        return pa.table({"chunk": part["chunk"][:1], "counts": pa.array([zlib.compress(np.minimum(total, 65535).astype(np.uint16).tobytes(), 1)], pa.binary())})

    schema = "chunk int, counts binary"
    # one row a task and chunk, summed in two steps so that no task takes in those of all tasks
    salted = texts.select("text").mapInArrow(count, schema).withColumn("salt", F.spark_partition_id() % 64)
    first = salted.groupBy("chunk", "salt").applyInArrow(add, schema)
    chunks = {r["chunk"]: r["counts"] for r in first.groupBy("chunk").applyInArrow(add, schema).collect()}
    return np.frombuffer(b"".join(zlib.decompress(chunks[k]) for k in sorted(chunks)), np.uint16) if chunks else np.zeros(1 << bits, np.uint16)


def _message(kind: int, deal, name, packed, doc) -> pa.RecordBatch:
    i64 = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
    return pa.record_batch({"kind": pa.array(np.full(len(deal), kind, np.int8)), "deal": i64(deal), "name": i64(name), "packed": i64(packed), "doc_id": doc if isinstance(doc, pa.Array) else i64(doc)})


MESSAGES = "kind byte, deal long, name long, packed long, doc_id long"


def meeting(texts: DataFrame, s: Settings) -> DataFrame:
    """DOC rows (doc_id, name, packed = set size) and MEMBER rows (deal = pivot's name, name = member's)."""
    spark = texts.sparkSession
    counts = spark.sparkContext.broadcast(rarity(texts, s))  # at most 32 MB

    def posted(posts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, name, packed = (np.concatenate(x) for x in zip(*posts, strict=True))
        return _message(POST, token, name, packed, np.zeros(len(token), np.int64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - int(np.log2(len(counts.value))))
        for batch in batches:
            sizes, names, posts, seen, waiting = [], [], [], set(), 0
            for x in sets_of(batch.column(1), s.width):
                n = len(x)
                name = set_name(x)
                sizes.append(n)
                names.append(name)
                if n and (name, n) not in seen:
                    seen.add((name, n))
                    often = counts.value[(x >> shift).astype(np.int64)].astype(np.uint64)
                    p = prefix_length(n, s)
                    token = (often << np.uint64(48)) | (x >> np.uint64(16))
                    token = np.sort(token)[:p]
                    typical = min(127, int(8 * np.log2(1 + float(often.mean()))))
                    # set size, place in the order, how typical: 28, 27 and 7 bits
                    packed = (np.int64(n) << np.int64(35)) | (np.arange(p, dtype=np.int64) << np.int64(7)) | np.int64(typical)
                    posts.append((token, np.full(p, name, np.int64), packed))
                    waiting += p
                    if waiting > 200_000:
                        yield posted(posts)
                        posts, waiting = [], 0
            size = np.array(sizes, np.int64)
            ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
            yield _message(DOC, mix(ids.view(np.uint64)), np.array(names, np.int64), size, batch.column(0))
            if posts:
                yield posted(posts)

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        kind = held["kind"].to_numpy()
        docs = held.filter(pa.array(kind == DOC)).combine_chunks()
        yield from docs.to_batches()
        posts = held.filter(pa.array(kind == POST))
        token, name, packed = (posts[c].to_numpy() for c in ("deal", "name", "packed"))
        order = np.argsort(token)
        t = token[order]
        new = np.concatenate([np.ones(min(1, len(t)), bool), t[1:] != t[:-1]])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(t)))
        pivots, members = [], []
        for a, g in zip(heads[sizes > 1], sizes[sizes > 1], strict=True):
            at = order[a : a + g]
            w, first = np.unique(name[at], return_index=True) if g > 2 else (name[at], np.arange(2))
            if len(w) < 2 or g == 2 and w[0] == w[1]:
                continue
            p = packed[at[first]]
            n, place = p >> 35, (p >> 7) & ((1 << 27) - 1)
            keep = could_link(n, place, s)
            if keep.sum() < 2:
                continue
            w, p = w[keep], p[keep]
            lead = np.lexsort((w, -(p & 127)))[0]
            pivots.append(np.full(len(w), w[lead], np.int64))
            members.append(w)
        if pivots:
            p, m = np.concatenate(pivots), np.concatenate(members)
            order = np.lexsort((m, p))
            p, m = p[order], m[order]
            once = np.concatenate([[True], (p[1:] != p[:-1]) | (m[1:] != m[:-1])])
            none = np.zeros(int(once.sum()), np.int64)
            yield _message(MEMBER, p[once], m[once], none, none)
        release()

    n_docs = texts.count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-n_docs * 128 // s.rows_per_task))
    return stage_table(texts.mapInArrow(emit, MESSAGES).repartition(tasks, "deal").mapInArrow(regions, MESSAGES), "meeting")


def could_link(n: np.ndarray, place: np.ndarray, s: Settings) -> np.ndarray:
    """Which of the points that share a shingle at these places may link with another one of them.

    An overlap has at most this shingle and what stands behind it in both orders; smaller sets
    need ``num / den`` of the larger one's size.
    """
    out = np.zeros(len(n), bool)
    rest = n - place  # this shingle and those behind it
    order = np.argsort(n, kind="stable")
    size, left = n[order], rest[order]
    upto = np.searchsorted(size, size * s.den // s.num, "right")  # partners up to this size
    for i in range(len(size)):
        stop = upto[i]
        j = slice(i + 1, stop)
        if stop > i + 1:
            overlap = np.minimum(left[i], left[j])
            ok = s.den * overlap >= s.num * (size[i] + size[j] - overlap)
            if ok.any():
                out[order[i]] = True
                out[order[j][ok]] = True
    return out


class Joined:
    """Connected groups of a region's points."""

    def __init__(self, n: int):
        self.group = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Connect i with ``others``; returns those whose group changes by it (one a group)."""
        groups, first = np.unique(self.group[others], return_index=True)
        new = groups != self.group[i]
        if new.any():
            self.group[np.isin(self.group, groups[new])] = self.group[i]
        return others[first[new]]


def link_region(points: list[np.ndarray], pivot: int, s: Settings, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``points`` (sorted distinct shingles).

    The pivot comes first; then each point beyond ``eps`` of it, or each of ``left`` if that is
    given, is measured against the points that the triangle inequality and the groups so far leave
    open.  A point of ``left`` may be near the pivot and still have links to points far from it.
    """
    n = len(points)
    size = np.array([len(p) for p in points])
    flat, begin = np.concatenate(points), np.concatenate([[0], np.cumsum(size)])
    groups = Joined(n)
    links: list[tuple[int, int]] = []

    def overlaps(i: int, among: np.ndarray) -> np.ndarray:
        own = points[i]
        total = size[among]
        at = np.repeat(begin[among] - (np.cumsum(total) - total), total) + np.arange(int(total.sum()))
        shingle = flat[at]
        found = np.minimum(np.searchsorted(own, shingle), len(own) - 1)
        return np.add.reduceat((own[found] == shingle).astype(np.int64), np.cumsum(total) - total)

    def measure(i: int, among: np.ndarray) -> np.ndarray:
        """Distances, as union and overlap decide them; links are joined on the way."""
        both = overlaps(i, among)
        union = size[among] + size[i] - both
        near = among[s.den * both >= s.num * union]
        near = near[near != i]
        if len(near):
            links.extend((i, int(j)) for j in groups.join(i, near))
        return 1 - both / union

    everyone = np.arange(n)
    far = measure(pivot, everyone)
    eps = 1 - s.num / s.den
    ring = np.flatnonzero(far > eps + 1e-9 if left is None else left)
    for i in ring[np.argsort(far[ring], kind="stable")]:
        # a link to i must be as far from the pivot as i, give or take eps, and of a size near its own
        open_ = (groups.group != groups.group[i]) & (np.abs(far - far[i]) <= eps + 1e-9) & (size * s.den >= s.num * size[i]) & (size[i] * s.den >= s.num * size)
        among = np.flatnonzero(open_)
        if len(among):
            measure(int(i), among)
    return links


def region_links(sets: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links over names, enough of them to connect what is linked; ``sets``: (name, shingles)."""
    spark = sets.sparkSession
    schema = "a long, b long"
    sized = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("points"))
    small = members.join(sized.where(F.col("points") <= s.region_max), "pivot")
    large = members.join(sized.where(F.col("points") > s.region_max), "pivot")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_small, n_large = (r.count() for r in (small, large))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        region, pivot, name, ringed = (held[c].to_numpy() for c in ("region", "pivot", "name", "ringed"))
        shingles = held["shingles"].combine_chunks()
        order = np.lexsort((name, region))
        cuts = np.flatnonzero(np.concatenate([[True], region[order][1:] != region[order][:-1]]))
        a, b = [], []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            at = order[lo:hi]
            if len(at) < 2:
                continue
            points = [np.frombuffer(shingles[int(i)].as_buffer(), np.uint64) for i in at]
            first = np.flatnonzero(name[at] == pivot[at])
            for i, j in link_region(points, int(first[0]) if len(first) else 0, s, ringed[at] if len(first) == 0 else None):
                a.append(name[at[i]])
                b.append(name[at[j]])
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        release()

    def dealt(rows: DataFrame, n: int) -> DataFrame:
        return rows.select("region", "pivot", "name", "ringed", "shingles").repartition(max(least, -(-n // 2000)), "region").mapInArrow(link, schema)

    rows = small.join(sets, "name").select(F.col("pivot").alias("region"), "pivot", "name", F.lit(True).alias("ringed"), "shingles")
    links = dealt(rows, n_small)
    if n_large:
        links = links.unionByName(large_region_links(sets, large, s, dealt))
    return links


def large_region_links(sets: DataFrame, large: DataFrame, s: Settings, dealt) -> DataFrame:
    """Regions beyond one task: near points are linked to the pivot, the others meet all points in windows."""
    pivots = sets.withColumnsRenamed({"name": "pivot", "shingles": "pivot_shingles"})
    both = large.join(sets, "name").join(pivots, "pivot")  # Spark splits a skewed pivot

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap, union = [], []
            for x, p in zip(batch.column(2), batch.column(3), strict=True):
                x, p = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, p))
                k = len(np.intersect1d(x, p, assume_unique=True))
                overlap.append(k)
                union.append(len(x) + len(p) - k)
            yield pa.record_batch({"pivot": batch.column(0), "name": batch.column(1), "overlap": pa.array(overlap, pa.int64()), "united": pa.array(union, pa.int64())})

    measured = stage_table(both.select("pivot", "name", "shingles", "pivot_shingles").mapInArrow(measure, "pivot long, name long, overlap long, united long"), "measured")
    near = F.col("overlap") * s.den >= F.col("united") * s.num
    linked = measured.where(near & (F.col("pivot") != F.col("name"))).select(F.col("pivot").alias("a"), F.col("name").alias("b"))
    eps = 1 - s.num / s.den
    # points are dealt into blocks by hash within slices of the distance to the pivot as wide as eps: windows of a point are its slice and the two beside it
    far = 1 - F.col("overlap") / F.col("united")
    half = max(1, s.region_max // 2)
    placed = measured.select("pivot", "name", (~near).alias("ringed"), F.floor(far / eps).cast("int").alias("slice"))
    counts = placed.groupBy("pivot", "slice").agg(F.ceil(F.count(F.lit(1)) / half).alias("blocks"), F.ceil(F.count_if("ringed") / half).alias("ring_blocks"))
    h = F.xxhash64("name")
    own = placed.join(counts, ["pivot", "slice"])
    ring = own.where("ringed").select("pivot", "name", "slice", F.pmod(h, F.col("ring_blocks")).alias("ring_block"), F.explode(F.array(F.col("slice") - 1, F.col("slice"), F.col("slice") + 1)).alias("other"))
    meets = ring.join(counts.select("pivot", F.col("slice").alias("other"), "blocks"), ["pivot", "other"]).select(
        "pivot", "name", F.col("slice").alias("rs"), "ring_block", F.col("other").alias("os"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("ringed")
    )
    ring_counts = counts.where("ring_blocks > 0").select("pivot", F.col("slice").alias("rs"), "ring_blocks")
    met = (
        own.select("pivot", "name", F.col("slice").alias("os"), F.pmod(h, F.col("blocks")).alias("block"), F.explode(F.array(F.col("slice") - 1, F.col("slice"), F.col("slice") + 1)).alias("rs"))
        .join(ring_counts, ["pivot", "rs"])
        .select("pivot", "name", "rs", F.explode(F.sequence(F.lit(0), F.col("ring_blocks") - 1)).alias("ring_block"), "os", "block", F.lit(False).alias("ringed"))
    )
    rows = meets.unionByName(met).groupBy("pivot", "rs", "ring_block", "os", "block", "name").agg(F.max("ringed").alias("ringed"))
    rows = stage_table(rows.select(F.xxhash64("pivot", "rs", "ring_block", "os", "block").alias("region"), F.lit(None).cast("long").alias("none"), "name", "ringed"), "windows")
    filled = rows.join(sets, "name").select("region", F.coalesce("none", F.lit(0)).alias("pivot"), "name", "ringed", "shingles")
    return linked.unionByName(dealt(filled, rows.count()))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, by minimum labels and pointer jumping."""
    both = stage_table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        best = label.join(seen, label["node"] == seen["a"]).select("node", "component", F.least("component", "m").alias("low"))
        # a node's label also learns what the node has found
        told = best.select("node", "low").unionByName(best.select(F.col("component").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        jumped = told.join(told.select(F.col("node").alias("low"), F.col("low").alias("next")), "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("component"))
        old = label.withColumnRenamed("component", "was")
        label = checkpointed(jumped.join(old, "node").select("node", "component", "was"))
        moved = label.where("component <> was").limit(1).count()
        label = label.select("node", "component")
        if not moved:
            return label


def named_rows(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Every row with its set's name: name (0 if without shingle), row (all columns)."""
    fields = docs.select(F.struct("*").alias("row")).schema["row"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [set_name(x) for x in sets_of(batch.column(0), s.width)]
            yield pa.record_batch({"name": pa.array(names, pa.int64()), "row": batch.column(1)})

    given = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("row"))
    return given.mapInArrow(name, StructType([StructField("name", LongType()), fields]))


def join_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    own, named = joined_sets(docs, s)
    return own.join(named, "name", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_components(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(name, doc_id), one of each component of texts with shingles: the smallest doc_id (null last), then name."""
    _, named = joined_sets(docs, s)
    first = named.groupBy("component").agg(F.min(F.struct(F.col("lead").isNull(), "lead", "name")).alias("first"))
    return first.select("first.name", F.col("first.lead").alias("doc_id"))


def joined_sets(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, name, n_shingles), and of each distinct set (name, lead, component_id, component's name)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    met = meeting(texts, s)
    own = met.where(F.col("kind") == DOC).select("doc_id", "name", F.col("packed").alias("n_shingles"))
    points = own.where("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("lead"))
    members = stage_table(met.where(F.col("kind") == MEMBER).select(F.col("deal").alias("pivot"), "name").distinct(), "members")
    wanted = members.select("name").distinct().join(points, "name").select("name", F.col("lead").alias("doc_id"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, x.tobytes()) for w, x in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), s.width), strict=True) if set_name(x) == w]
            yield pa.record_batch({"name": pa.array([f[0] for f in found], pa.int64()), "shingles": pa.array([f[1] for f in found], pa.binary())})

    def spell_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(set_name(x), x.tobytes()) for x in sets_of(batch.column(0), s.width)]
            yield pa.record_batch({"name": pa.array([f[0] for f in found], pa.int64()), "shingles": pa.array([f[1] for f in found], pa.binary())})

    spelled = texts.join(wanted, "doc_id").select("name", "text").mapInArrow(spell, "name long, shingles binary")
    # a set of rows without an id has no id to be fetched by
    without = texts.where("doc_id is null").select("text").mapInArrow(spell_all, "name long, shingles binary")
    spelled = spelled.unionByName(without.join(wanted.where("doc_id is null").select("name"), "name", "left_semi"))
    sets = stage_table(spelled, "sets").dropDuplicates(["name"])
    links = region_links(sets, members, s)
    of = components(links)
    whole = of.join(points.withColumnRenamed("name", "node"), "node")
    low = whole.groupBy("component").agg(F.min("lead").alias("component_id"))
    named = points.join(whole.join(low, "component").select(F.col("node").alias("name"), "component", "component_id"), "name", "left")
    return own, named.select("name", "lead", F.coalesce("component_id", "lead").alias("component_id"), F.coalesce("component", "name").alias("component"))


def set_name(x: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets only are one point."""
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) if len(x) else 0
