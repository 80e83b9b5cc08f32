import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_cases import doc_frame, edge_texts, empty_docs

from fairlease.llm import periodic


def brute_runs(words, least=24, cubes=3):
    n, out = len(words), {}
    for q in range(1, n // cubes + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, cubes * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def planted(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = (None,) * 4
    if runs:
        s, n, q = sorted(runs, key=lambda r: (-(r[1] * 10**12) // r[2], r[0], r[2]))[0]
        top = (s, n, q, 1000 * n // q)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def words_of(parts):
    return np.array(parts)


def hostile(rng):
    """Word sequences with periods inside periods, near misses and grams that come many times."""
    x, y = [rng.randrange(1000) for _ in range(20)], [rng.randrange(1000) for _ in range(17)]
    yield [0] * 23
    yield [0] * 24
    yield [0] * 700
    yield [0, 1] * 12
    yield list(range(8)) * 3
    yield list(range(8)) * 2 + list(range(7))
    yield list(range(9)) * 2 + list(range(8)) + [99]
    yield list(range(500)) * 3
    yield list(range(500)) * 2 + list(range(499))
    de_bruijn = [x, x, x, y, x, y, y, y]
    yield sum(de_bruijn * 4, [])  # every 16-gram comes twice in the period
    yield sum([x + x + y] * 5, [])
    yield [1] * 40 + [2] * 40 + [1] * 40
    yield ([1] * 30 + [2]) * 4
    yield ([0, 1] * 15 + [2]) * 3 + [0, 1] * 15
    thue = [0]
    while len(thue) < 4096:
        thue += [1 - t for t in thue]
    yield thue
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]


def test_runs_of_hostile_sequences():
    for words in hostile(random.Random(3)):
        assert periodic.runs(np.array(words)) == brute_runs(words), words[:60]


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_sequences(letters):
    rng = random.Random(letters)
    for _ in range(150):
        words = []
        while len(words) < rng.randrange(30, 400):
            part = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
            words += (part * rng.randrange(1, 6))[: rng.randrange(1, 160)]
        assert periodic.runs(np.array(words)) == brute_runs(words)


def test_documents_by_brute_force(spark):
    rng = random.Random(5)
    rows = [r for r in edge_texts() if r[0] is not None and r[0] not in (17, 21)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 300)))) for i in range(120)]
    rows += [(2000 + i, " \t".join(["a b"] * i + ["tail"]) + "\n") for i in range(40)]
    rows += [(3000, ("x " * 30 + "y ") * 9)]
    got = sorted(tuple(r) for r in periodic.repeated_runs(doc_frame(spark, rows)).collect())
    want = sorted(expected(i, t) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert got == want
    assert sum(g[1] > 0 for g in got) > 10


def test_real_outputs(spark):
    rows = [(1, "head " + "p q r " * 9 + "tail"), (2, None)]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(doc_frame(spark, rows)).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 27, 3)]
    assert got[1]["collapsed"] == "head p q r tail" and got[1]["n_words"] == 29
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[2]["n_words"] == 0


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a " * 50), (None, "a " * 50), (7, None), (7, "a " * 50)]
    got = periodic.repeated_runs(doc_frame(spark, rows)).collect()
    assert len(got) == 4 and sum(r["n_runs"] for r in got) == 3
    assert periodic.repeated_runs(empty_docs(spark)).count() == 0


def test_long_texts_take_time_in_proportion():
    import time

    t = time.perf_counter()
    assert periodic.runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    rng = np.random.default_rng(1)
    part = rng.integers(0, 1000, 300_000)
    assert periodic.runs(np.concatenate([part, part, part])) == [(0, 900_000, 300_000)]
    assert time.perf_counter() - t < 60
