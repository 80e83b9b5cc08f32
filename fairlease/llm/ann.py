"""Nearest neighbours by largest inner product: a random-projection forest and exact reranking.

Trees are grown on a bounded sample: a node's direction is the difference of two sampled vectors,
its threshold the median projection.  Every vector is routed to one leaf a tree.  A query walks
all trees with one shared priority queue, nearest margin first, until the leaves it has met hold
enough of the sample; leaves and queries then meet in Spark, and the candidates of those leaves
are ranked by the exact inner product in double precision.  One more coordinate,
``sqrt(max norm^2 - norm^2)``, turns largest inner product into nearest distance for routing.

Leaves grow with the index: one of over a sixteenth of a task's rows is dealt by hash over several
tasks, and a query goes to each of them.  Vectors keep their element type (float or double; others
are read as double).

Defined results: vectors that are null, zero, hold null or non-finite components, or differ from
the most common dimension take no part; of equal vectors the smallest ids come first (only as many
as an answer can hold are indexed, which loses none); a repeated vec_id counts once with the first
of its vectors; fewer candidates than asked for give all of them (small tables are one leaf); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlease.llm.shared import stage_table


@dataclass(frozen=True)
class Settings:
    k: int = 20
    query_every: int = 20
    trees: int = 16
    sample: int = 65_536  # bound of the vectors that trees are grown on, in expectation
    leaf: int = 64  # sampled vectors of a leaf
    # a query visits leaves, over all trees, that hold visit * n ** visit_power of n sampled vectors, and no fewer than visit_least
    visit: float = 14.0
    visit_power: float = 0.7
    visit_least: int = 8_000
    # of an index larger than the sample the visited share falls by this power of index / sample: work a query grows by the 0.85th power
    visit_decay: float = 0.15
    part_rows: int = 131_072  # indexed rows (vector and tree) of one reranking task


@dataclass
class Forest:
    """Nodes of all trees: direction, threshold, children (a child below 0 is leaf -1 - child), roots."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaf_sizes: np.ndarray
    top_norm: float
    steps: tuple | None = None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector (rows) in each tree (columns)."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (open_ := np.flatnonzero(at >= 0)).size:
                node = at[open_]
                side = np.einsum("ij,ij->i", x[open_], self.directions[node]) > self.thresholds[node]
                at[open_] = self.children[node, side.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, enough: int) -> list[int]:
        """Leaves for one query by one priority queue over all trees."""
        if self.steps is None:
            self.steps = [tuple(c) for c in self.children.tolist()], self.leaf_sizes.tolist()
        children, sizes = self.steps
        heap = [(0.0, r) for r in self.roots]
        heapq.heapify(heap)
        found, held = [], 0
        margins = (self.directions @ q.astype(self.directions.dtype) - self.thresholds).tolist() if len(self.directions) else []
        pop, push = heapq.heappop, heapq.heappush
        while heap and held < enough:
            cost, node = pop(heap)
            while node >= 0:  # down the near side, the far one waits at its margin
                m = margins[node]
                left, right = children[node]
                if m > 0:
                    push(heap, (cost if cost > m else m, left))
                    node = right
                else:
                    push(heap, (cost if cost > -m else -m, right))
                    node = left
            found.append(-1 - node)
            held += sizes[-1 - node]
        return found


def lifted(x: np.ndarray, top_norm: float) -> np.ndarray:
    x = np.asarray(x, np.float64)
    rest = np.sqrt(np.maximum(top_norm**2 - np.square(x).sum(1), 0))
    return np.column_stack([x, rest])


def lifted_query(q: np.ndarray, top_norm: float) -> np.ndarray:
    q = np.asarray(q, np.float64)
    norm = np.sqrt(np.square(q).sum(1, keepdims=True))
    return np.column_stack([q / np.maximum(norm, 1e-300) * top_norm, np.zeros(len(q))])


def grow(x: np.ndarray, top_norm: float, s: Settings, seed: int = 0) -> Forest:
    """A forest over the sample ``x`` (lifted)."""
    directions, thresholds, children, roots, sizes = [], [], [], [], []
    rng = np.random.default_rng(seed)

    def split(rows: np.ndarray) -> int:
        if len(rows) > s.leaf:
            for _ in range(3):
                a, b = rng.choice(rows, 2, replace=False)
                d = x[a] - x[b]
                norm = np.sqrt(d @ d)
                if norm > 0:
                    p = x[rows] @ (d / norm)
                    cut = float(np.median(p))
                    right = p > cut
                    if right.any() and not right.all():
                        node = len(directions)
                        directions.append(d / norm)
                        thresholds.append(cut)
                        children.append([0, 0])
                        children[node] = [split(rows[~right]), split(rows[right])]
                        return node
        sizes.append(len(rows))
        return -len(sizes)

    for _ in range(s.trees):
        roots.append(split(np.arange(len(x))))
    dim = x.shape[1]
    return Forest(np.array(directions).reshape(-1, dim), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), roots, np.array(sizes), top_norm)


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of doubles."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and embedding (array of float or double) of the vectors that take part, one row a vec_id."""
    kept = vectors.schema["embedding"].dataType.elementType.typeName() in ("float", "double")
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding" if kept else F.col("embedding").cast("array<double>"))
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    known = vectors.where("vec_id is not null").select("vec_id", "embedding").where(F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False)))
    sizes = known.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").limit(1).collect()
    if not sizes:
        return known.limit(0)
    once = Window.partitionBy("vec_id").orderBy("embedding")
    return known.where(F.size("embedding") == sizes[0]["dim"]).withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")


def visited_rows(total: int, sampled: int, s: Settings) -> int:
    """Sampled rows, over all trees, whose leaves a query visits in an index of ``total`` vectors."""
    least = max(int(s.visit * sampled**s.visit_power), s.visit_least)
    return int(least * (sampled / total) ** s.visit_decay) if total > sampled else least


def nearest(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    rows = stage_table(usable(vectors), "vectors")
    # of equal vectors the k + 1 smallest ids hold every answer
    same = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = rows.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= s.k + 1)
    held = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("lead"))
    index = stage_table(held, "index")
    total = index.count()
    out_schema = "query_id long, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    top_norm = float(index.agg(F.max(norm(F.col("embedding")))).collect()[0][0])
    share = min(1.0, s.sample / total)
    pick = F.pmod(F.xxhash64("lead", F.lit("forest")), F.lit(1 << 30)) < int((1 << 30) * share)
    sampled = index.where(pick).select("lead", "embedding").toArrow().sort_by("lead")
    if not sampled.num_rows:
        sampled = index.select("lead", "embedding").orderBy("lead").limit(1).toArrow()
    forest = grow(lifted(matrix(sampled["embedding"]), top_norm), top_norm, s)
    forest.directions = forest.directions.astype(np.float32)
    sent = spark.sparkContext.broadcast(forest)  # bounded by the sample
    parts = max(1, -(-total * s.trees // s.part_rows))
    enough = visited_rows(total, sampled.num_rows, s)
    # a leaf's rows are dealt into so many, by hash of the vector's smallest id; leaves are numbered accordingly
    deals = max(1, -(-16 * s.leaf * total // (sampled.num_rows * s.part_rows)))
    vector = rows.schema["embedding"].dataType.simpleString()

    def part_of(leaf: np.ndarray) -> np.ndarray:
        return (leaf * 0x9E3779B1 % (1 << 32)) * parts >> 32

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            leaves = sent.value.leaves(lifted(matrix(batch.column(1)), sent.value.top_norm)) if batch.num_rows else np.empty((0, s.trees), np.int64)
            at = np.repeat(np.arange(batch.num_rows), leaves.shape[1])
            dealt = np.array([x[0] for x in batch.column(0).to_pylist()], np.int64) * 0x9E3779B1 % (1 << 32) * deals >> 32
            leaf = leaves.ravel() * deals + dealt[at]
            yield pa.RecordBatch.from_arrays([pa.array(part_of(leaf).astype(np.int32)), pa.array(leaf), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["part", "leaf", "ids", "embedding"])

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            part, row, leaves = [], [], []
            q = lifted_query(matrix(batch.column(1)), sent.value.top_norm) if batch.num_rows else []
            for i, x in enumerate(q):
                found = (np.array(sorted(sent.value.search(x, enough)), np.int64)[:, None] * deals + np.arange(deals)).ravel()
                p = part_of(found)
                for k in np.unique(p):
                    part.append(int(k))
                    row.append(i)
                    leaves.append(found[p == k])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(leaves, pa.list_(pa.int64()))], names=["part", "query_id", "embedding", "leaves"])

    def rerank(left, right):
        import pyarrow as pa

        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        v, q = matrix(left["embedding"]), matrix(right["embedding"])
        ids = left["ids"].to_pylist()
        leaf = np.asarray(left["leaf"])
        order = np.argsort(leaf, kind="stable")
        first = dict(zip(*np.unique(leaf[order], return_index=True), strict=True))
        last = {k: f + n for (k, f), n in zip(first.items(), np.unique(leaf, return_counts=True)[1], strict=True)}
        asked: dict[int, list[int]] = {}
        for i, wanted in enumerate(right["leaves"].to_pylist()):
            for w in wanted:
                asked.setdefault(w, []).append(i)
        keep = s.k + 1  # the query itself may be among them
        kth = np.full(len(q), -np.inf)
        pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def cut() -> None:
            nonlocal pool, waiting
            who, what, how = (np.concatenate(x) for x in zip(*pool, strict=True))
            by = np.lexsort((what, -how, who))
            who, what, how = who[by], what[by], how[by]
            again = np.zeros(len(who), bool)
            again[1:] = (who[1:] == who[:-1]) & (what[1:] == what[:-1])
            who, what, how = who[~again], what[~again], how[~again]
            starts = np.searchsorted(who, np.arange(len(q) + 1))
            place = np.arange(len(who)) - starts[who]
            kth[who[place == keep - 1]] = how[place == keep - 1]
            good = place < keep
            pool, waiting = [(who[good], what[good], how[good])], 0

        # one vector stands in several trees: name it by its smallest id, so that repeats meet
        lead = np.array([x[0] for x in ids], np.int64)
        named, name = np.unique(lead, return_inverse=True)
        some_row = np.zeros(len(named), np.int64)
        some_row[name] = np.arange(len(lead))
        for w, who in asked.items():
            if w not in first:
                continue
            rows, who = order[first[w] : last[w]], np.array(who)
            scores = q[who] @ v[rows].T
            a, b = np.nonzero(scores >= kth[who][:, None] - 1e-9 * np.abs(kth[who][:, None], where=np.isfinite(kth[who][:, None]), out=np.zeros((len(who), 1))))
            pool.append((who[a], name[rows[b]], scores[a, b]))
            waiting += len(a)
            if waiting > 500_000:
                cut()
        if not pool:
            return empty
        cut()
        who, what, _ = pool[0]
        exact = (q[who] * v[some_row[what]]).sum(1)
        many = np.array([len(x) for x in ids])[some_row[what]]
        flat = np.concatenate([np.array(ids[r], np.int64) for r in some_row[what]]) if len(what) else np.empty(0, np.int64)
        return pa.table({"query_id": np.asarray(right["query_id"])[np.repeat(who, many)], "vec_id": flat, "score": np.repeat(exact, many)})

    placed = index.select("ids", "embedding").mapInArrow(route, f"part int, leaf long, ids array<long>, embedding {vector}")
    queries = rows.where(F.col("vec_id") % s.query_every == 0).select("vec_id", "embedding")
    n_queries = queries.count()
    spread = max(min(64, n_queries // 64 + 1), n_queries // 1024)
    asked = queries.repartition(spread, "vec_id").mapInArrow(walk, f"part int, query_id long, embedding {vector}, leaves array<long>")
    found = placed.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(rerank, out_schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
