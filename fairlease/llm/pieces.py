"""Subword encoding and decoding over a piece vocabulary, with the N best segmentations.

The pieces, their scores and the byte fallback come from a SentencePiece model file; text is
prefixed with one space and spaces become the space mark.  A segmentation's score is the sum of
its pieces' scores.  Over a text's piece lattice a forward Viterbi pass gives every position its
best score; a backward A* search from the end then takes those scores as exact heuristics, so
paths come out best first.

No piece reaches over the start of a word (checked when the model is loaded; if some did, a text
would be one lattice), so a text's lattice falls into one part a word: words are searched once
each, and the text's N best are the best sums of the words' lists.

Scores are often whole numbers, so a text without spaces has exponentially many paths of equal
score.  Of equal ones the search follows the path that reaches furthest, and it goes on from a
position at most N times: the paths that pass it come best first, and no N + 1st can be among the
N best.  Time and memory are bounded by N times the lattice.

Defined results: null text counts as empty and has no pieces and one segmentation, the empty one;
a character without a piece becomes its bytes' pieces; score ties go to the path that the search
completes first, which depends on the text alone; repeated rows are encoded alike; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlease.llm.text import LARGE_BLOCK, RollingHash, WordTable, blocks, gather

SPACE = "▁"
#: Below the lowest usable piece: the score of a character that only bytes can spell.
UNKNOWN_PENALTY = 10.0
UNUSED_SCORE = -1e8
#: Longer words' lists are not kept.
LIST_LETTERS = 64


@dataclass(frozen=True)
class Lattice:
    """Edges (start, end, piece ids, score) of a word, by start."""

    edges: list[tuple[int, int, tuple[int, ...], float]]
    best: list[float]  # forward Viterbi score of each position
    back: list[int]  # start of the best edge that ends at each position


@dataclass(frozen=True)
class Word:
    ids: tuple[int, ...]
    score: float
    gap: float  # how much worse the second best is; inf without one


class Model:
    """Pieces of a model file with cached word segmentations (at most ``keep`` words)."""

    def __init__(self, path: str, keep: int = 1_600_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.GetPieceSize()
        skip = [sp.IsControl(i) or sp.IsUnknown(i) or sp.IsUnused(i) for i in range(n)]
        self.byte_ids = {int(sp.IdToPiece(i)[1:-1], 16): i for i in range(n) if sp.IsByte(i)}
        self.setup({sp.IdToPiece(i): (i, sp.GetScore(i)) for i in range(n) if not skip[i] and not sp.IsByte(i)}, keep)

    @classmethod
    def of(cls, scored: dict[str, tuple[int, float]], byte_ids: dict[int, int]) -> Model:
        self = cls.__new__(cls)
        self.byte_ids = byte_ids
        self.setup(scored, 10_000)
        return self

    def setup(self, pieces: dict[str, tuple[int, float]], keep: int) -> None:
        self.pieces, self.keep = pieces, keep
        self.bytes_of = {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.longest = max(map(len, pieces), default=1)
        # a piece's ids and score; False for what only begins a piece
        self.steps = {p[:k]: False for p in pieces for k in range(1, len(p))} | {p: ((i,), s) for p, (i, s) in pieces.items()}
        self.unknown = min((s for _, s in pieces.values() if s > UNUSED_SCORE), default=0.0) - UNKNOWN_PENALTY
        several = [p for p in pieces if len(p) > 1]
        self.crossing = any(SPACE in p[1:] and set(p) != {SPACE} for p in several)
        joined = set("".join(several))
        self.alone = np.zeros(256, bool)
        self.alone[[ord(c) for c in "\n\t\r" if c not in joined]] = True
        self.table = WordTable(keep, {"score": np.float64, "gap": np.float64}, "ids", np.uint32)
        self.lists: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}

    def lattice(self, word: str) -> Lattice:
        """All edges by start, and the forward Viterbi score of each position."""
        n, get, longest = len(word), self.steps.get, self.longest
        edges: list[tuple[int, int, tuple[int, ...], float]] = []
        best, back = [-np.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            lone = True
            for j in range(i + 1, min(n, i + longest) + 1):
                found = get(word[i:j])
                if found is None:
                    break  # no piece begins so
                if found:
                    ids, score = found
                    edges.append((i, j, ids, score))
                    if here + score > best[j]:
                        best[j], back[j] = here + score, i
                    if j == i + 1:
                        lone = False
            if lone:  # no piece for the character itself: its bytes
                edges.append((i, i + 1, tuple(self.byte_ids[b] for b in word[i].encode()), self.unknown))
                if here + self.unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = here + self.unknown, i
        return Lattice(edges, best, back)

    def segment(self, word: str) -> Word:
        """The best segmentation and the distance of the second best."""
        whole = self.lattice(word)
        best, n = whole.best, len(word)
        path, j = {}, n
        while j:
            path[j] = whole.back[j]
            j = whole.back[j]
        ids: list[tuple[int, ...]] = []
        rest = [-np.inf] * n + [0.0]  # best score from each position to the end
        second = -np.inf
        for i, j, edge_ids, score in reversed(whole.edges):
            r = rest[j] + score
            if r > rest[i]:
                rest[i] = r
            if path.get(j) == i:
                ids.append(edge_ids)
            elif best[i] + r > second:
                second = best[i] + r
        return Word(tuple(x for e in reversed(ids) for x in e), best[n], best[n] - second)

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations (score, ids) of a word by backward A*, best first."""
        found = self.lists.get((word, n))
        if found is not None:
            return found
        whole = self.lattice(word)
        ends: list[list] = [[] for _ in range(len(word) + 1)]
        for i, j, edge_ids, score in whole.edges:
            ends[j].append((i, edge_ids, score))
        # (-(best way to here + what follows), position, order of discovery, what follows, path of edges behind)
        heap, met, out = [(-whole.best[len(word)], len(word), 0, 0.0, None)], 1, []
        passed = [0] * (len(word) + 1)
        while heap and len(out) < n:
            _, j, _, after, path = heapq.heappop(heap)
            if passed[j] == n:
                continue
            passed[j] += 1
            if j == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((after, tuple(ids)))
                continue
            for i, edge_ids, s in ends[j]:
                if passed[i] < n:
                    heapq.heappush(heap, (-(whole.best[i] + s + after), i, met, s + after, (edge_ids, path)))
                    met += 1
        if len(word) <= LIST_LETTERS and len(self.lists) < self.keep // 10:
            self.lists[(word, n)] = out
        return out

    def word_spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with the leading spaces, starts, ends, words before each text).

        A word starts at the first space of a run, and at and after a character that is in no
        longer piece; the words of a text are the whole text.
        """
        filled = np.flatnonzero(np.diff(offsets))  # an empty text gets no leading space and no word
        put = np.empty(len(data) + len(filled), np.uint8)
        heads = offsets[filled] + np.arange(len(filled))
        inner = np.ones(len(put), bool)
        inner[heads] = False
        put[heads] = 32
        put[inner] = data
        if self.crossing:
            opens = np.zeros(len(put), bool)
        else:
            space, alone = put == 32, self.alone[put]
            opens = space | alone
            opens[1:] &= ~(space[1:] & space[:-1])
            opens[1:] |= alone[:-1]
        opens[heads] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(put))[: len(starts)]
        size = np.diff(offsets)
        return put, starts, ends, np.searchsorted(starts, offsets + np.concatenate([[0], np.cumsum(size > 0)]))

    def encode_block(self, data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text of a block its ``n`` best segmentations (score, ids), best first."""
        put, starts, ends, before = self.word_spans(data, offsets)
        raw = put.tobytes()
        word = lambda w: raw[starts[w] : ends[w]].decode().replace(" ", SPACE)

        def make(at: np.ndarray) -> dict:
            words = [word(w) for w in at]
            found = [self.segment(w) for w in words]
            return {"ids": [f.ids for f in found], "score": [f.score for f in found], "gap": [f.gap for f in found]}

        slot, columns, values, firsts = self.table.resolve(RollingHash(put).of(starts, ends), make)
        ids, sizes = gather(slot, values, firsts)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        for a, b in zip(before[:-1], before[1:], strict=True):
            own = slot[a:b]
            total = float(columns["score"][own].sum())
            best = ids[cuts[a] : cuts[b]]
            out = [(total, best)]
            # a list of n needs at most the n - 1 words whose second best costs least
            gap = columns["gap"][own]
            if n > 1 and len(gap):
                near = np.argsort(gap, kind="stable") if len(gap) < n else np.flatnonzero(gap <= np.partition(gap, n - 2)[n - 2])
                near = sorted(near[np.isfinite(gap[near])], key=lambda k: (gap[k], k))[: n - 1]
                sums: list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]] = [(0.0, ())]
                for k in near:
                    own_list = self.n_best(word(a + k), n)
                    top, own_best = own_list[0][0], tuple(ids[cuts[a + k] : cuts[a + k + 1]].tolist())
                    others = [(score, alt) for score, alt in own_list if alt != own_best][: n - 1]
                    grown = sums + [(lost + top - score, (*changed, (k, alt))) for lost, changed in sums for score, alt in others]
                    sums = sorted(grown, key=lambda g: g[0])[:n]
                for lost, changed in sums[1:]:
                    parts, done = [], cuts[a]
                    for k, alt in sorted(changed):
                        parts += [ids[done : cuts[a + k]], np.array(alt, ids.dtype)]
                        done = cuts[a + k + 1]
                    out.append((total - lost, np.concatenate([*parts, ids[done : cuts[b]]])))
            yield out

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations (score, ids) of a text, best first."""
        raw = text.encode()
        found = next(self.encode_block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), n))
        return [(score, ids.tolist()) for score, ids in found]

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text again: bytes joined, space marks back to spaces, the leading one dropped."""
        text = self.spelled(ids).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str, n: int = 4) -> DataFrame:
    """Per document its best ids (count, checksum, score), whether they decode to the text, and the N best.

    ``round_trip`` compares the decoded ids with the text.
    """
    schema = "doc_id long, n_pieces int, ids_crc32 long, score double, round_trip boolean, nbest array<struct<score:double,n_pieces:int,ids_crc32:long>>"
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows = []
            for _, _, data, offsets in blocks(batch.column(1), LARGE_BLOCK):
                raw = data.tobytes()
                for found, a, b in zip(m.encode_block(data, offsets, n), offsets[:-1], offsets[1:], strict=True):
                    nbest = [{"score": s, "n_pieces": len(i), "ids_crc32": crc(i)} for s, i in found]
                    same = m.decode(found[0][1].tolist()) == raw[a:b].decode()
                    rows.append((nbest[0]["n_pieces"], nbest[0]["ids_crc32"], found[0][0], same, nbest))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_()),
                 pa.array(list(cols[4]), pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("ids_crc32", pa.int64())])))],
                names=["doc_id", "n_pieces", "ids_crc32", "score", "round_trip", "nbest"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the best segmentation's ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = [found[0][1].astype(np.int32) for _, _, data, offsets in blocks(batch.column(1), LARGE_BLOCK) for found in m.encode_block(data, offsets, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")
