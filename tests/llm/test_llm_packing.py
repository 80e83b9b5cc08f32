import zlib

import numpy as np
import public_tokenizers
from llm_cases import doc_frame, edge_texts, empty_docs
from tokenizers import Tokenizer

from fairlease.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(out, pieces, capacity):
    out = out.sort_values(["sequence_id", "offset"])
    assert len(out) == len(pieces)
    used = out.groupby("sequence_id")["length"].sum()
    assert used.max() <= capacity if len(used) else True
    assert (out.groupby("sequence_id")["length"].cumsum() - out["length"] == out["offset"]).all()
    return len(used)


def test_documents_are_whole_and_packed(spark):
    rows = [r for r in edge_texts() if r[0] is not None]
    out = packing.pack_documents(doc_frame(spark, rows), PATH).toPandas()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = sorted(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert got == sorted(want)
    assert check(out, want, 2048) == -(-sum(w[3] for w in want) // 2048)


def test_null_id_and_empty(spark):
    out = packing.pack_documents(doc_frame(spark, [(None, "a b"), (1, None)]), PATH).toPandas()
    assert len(out) == 2 and out.sequence_id.nunique() == 1
    assert packing.pack_documents(empty_docs(spark), PATH).count() == 0


def pieces_frame(spark, sizes):
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long")


def test_many_blocks_and_levels(spark):
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(1, 60, 3000), rng.integers(60, 101, 500), np.full(40, 100)])
    out = packing.pack_pieces(pieces_frame(spark, sizes), packing.Settings(capacity=100, block_items=128)).toPandas()
    bins = check(out, sizes, 100)
    assert sorted(out["length"]) == sorted(sizes) and bins <= 1.02 * -(-sizes.sum() // 100)


def test_sizes_that_never_fill(spark):
    sizes = [51] * 700
    out = packing.pack_pieces(pieces_frame(spark, sizes), packing.Settings(capacity=100, block_items=64)).toPandas()
    assert check(out, sizes, 100) == 700


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(2)
    s = packing.Settings(capacity=100)
    for _ in range(30):
        sizes = rng.integers(1, 100, 200)
        parents = []
        for _ in range(2):
            p = np.full(200, -1)
            packing.best_fit(sizes, rng.permutation(200).tolist(), p, [], 0, 100)
            parents.append(p)
        child = packing.crossover(sizes, *parents, 100, rng)
        assert (child >= 0).all() and packing.fills(sizes, child).max() <= 100
        people = packing.evolve(sizes, parents, s, 1)
        assert packing.fitness(sizes, people[0], 100) >= max(packing.fitness(sizes, p, 100) for p in parents)


def test_genetic_search_beats_one_best_fit():
    # three sizes that best-fit decreasing packs badly: 51+27+22 fill a bin
    sizes = np.array([51, 27, 22, 26, 49, 25] * 20)
    plain = np.full(len(sizes), -1)
    packing.best_fit(sizes, np.argsort(-sizes, kind="stable").tolist(), plain, [], 0, 100)
    people = packing.evolve(sizes, [], packing.Settings(capacity=100, population=8, generations=60), 0)
    assert packing.fitness(sizes, people[0], 100) >= packing.fitness(sizes, plain, 100)
