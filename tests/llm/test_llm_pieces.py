import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from llm_cases import doc_frame, edge_texts, empty_docs

from fairlease.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def small_model(seed=0):
    rng = random.Random(seed)
    spelled = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "ca", "▁ab", "aa", "▁▁"]
    byte_ids = {b: 1000 + b for b in range(256)}
    return pieces.Model.of({p: (i, -round(rng.uniform(1, 9), 3)) for i, p in enumerate(spelled)}, byte_ids)


def all_segmentations(m, text):
    text = (pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else ""

    def go(i):
        if i == len(text):
            yield 0.0, ()
        for j in range(i + 1, len(text) + 1):
            p = m.pieces.get(text[i:j])
            if p is None and j == i + 1:
                p = (tuple(m.byte_ids[b] for b in text[i].encode()), m.unknown)
            elif p is not None:
                p = ((p[0],), p[1])
            if p is not None:
                for s, ids in go(j):
                    yield p[1] + s, p[0] + ids

    return sorted(go(0), key=lambda x: -x[0])


def test_n_best_by_brute_force():
    for seed in range(4):
        m = small_model(seed)
        rng = random.Random(seed)
        for _ in range(60):
            text = "".join(rng.choice("aabbc é\n") for _ in range(rng.randrange(0, 9)))
            want = all_segmentations(m, text)
            for n in (1, 4, 7):
                got = m.encode(text, n)
                assert len(got) == min(n, len(want))
                assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]])
                assert len({tuple(i) for _, i in got}) == len(got)
                legal = {ids for _, ids in want}
                assert all(tuple(i) in legal for _, i in got)


def test_real_model_round_trip_and_best():
    m = pieces.model(PATH)
    rng = random.Random(5)
    alphabet = list("abcdefgh  \n\t.é日😀ﬁ") + ["the ", "ing"]
    for _ in range(200):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        found = m.encode(text, 3)
        assert all(m.decode(ids) == text for _, ids in found)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    short = "in the end"
    assert np.isclose(m.encode(short)[0][0], all_segmentations(m, short)[0][0])


def test_documents(spark):
    rows = edge_texts()
    docs = doc_frame(spark, rows)
    out = pieces.encode_documents(docs, PATH, 3).collect()
    m = pieces.model(PATH)
    assert len(out) == len(rows) and all(r["round_trip"] for r in out)
    by_id = {i: t or "" for i, t in rows}
    for r in out:
        want = m.encode(by_id[r["doc_id"]], 3)
        assert [(x["score"], x["n_pieces"], x["ids_crc32"]) for x in r["nbest"]] == [(s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for s, i in want]
        assert r["score"] == want[0][0] and r["n_pieces"] == len(want[0][1])
    assert out[1]["nbest"][0]["n_pieces"] == 0
    spelled = pieces.decode_documents(pieces.encode_ids(docs, PATH), PATH).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in spelled) == sorted((i or -1, t or "") for i, t in rows)
    assert pieces.encode_documents(empty_docs(spark), PATH).count() == 0


def test_full_table_keeps_results_right():
    m = pieces.Model(PATH, keep=3)
    texts = ["alpha beta", "gamma delta eps", "alpha zeta", "beta eta theta iota"]
    whole = pieces.model(PATH)
    for text in itertools.chain(texts, texts):
        assert m.encode(text, 2) == whole.encode(text, 2)


def distinct_paths(found, n, m, text):
    assert len(found) == n and len({tuple(i) for _, i in found}) == n
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    assert all(m.decode(ids) == text for _, ids in found)


def test_runs_without_spaces_end_soon():
    """Equal letters, two letters, DNA, base64 and random letters of 100,000 characters, one word each."""
    import time

    m = pieces.model(PATH)
    rng = random.Random(1)
    draw = lambda of, k=100_000: "".join(rng.choices(of, k=k))
    texts = ["a" * 100_000, "ab" * 50_000, draw("ACGT"), draw("ABCDEFGHabcdefgh0123456789+/"), draw("abcdefghijklmnopqrstuvwxyz")]
    t = time.perf_counter()
    for text in texts:
        for n in (1, 4, 16):
            distinct_paths(m.encode(text, n), n, m, text)
    assert time.perf_counter() - t < 120


def test_ties_by_brute_force():
    """Whole-number scores: many segmentations share one score."""
    m = pieces.Model.of({"▁": (0, -1.0), "a": (1, -2.0), "aa": (2, -4.0), "aaa": (3, -6.0), "ab": (4, -3.0), "b": (5, -1.0)}, {b: 1000 + b for b in range(256)})
    for text in ("aaaaaa", "aabab", "a aaa aab", "aaaaaaaaaa"):
        want = all_segmentations(m, text)
        for n in (1, 4, 7, 16):
            got = m.encode(text, n)
            assert [s for s, _ in got] == [s for s, _ in want[:n]]
            assert len({tuple(i) for _, i in got}) == len(got) and {tuple(i) for _, i in got} <= {ids for _, ids in want}


def test_word_table_is_bounded_by_entries():
    m = pieces.Model.of({"a": (1, -2.0), "▁": (0, -1.0)}, {b: 1000 + b for b in range(256)})
    limit = 2 * m.table.KEPT_VALUES * m.keep
    for k in range(20):
        m.encode("é" * (30_000 + k))
        assert len(m.table.values) <= limit
