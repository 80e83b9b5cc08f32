import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import doc_frame, edge_texts, empty_docs, sentence

from fairlease.llm import suffix


def brute(rows, length):
    """doc_id to the digest row; rows in order of doc_id."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def got(spark, rows, length):
    out = suffix.removed_documents(doc_frame(spark, rows), length).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out}


def passages(seed, n):
    rng = random.Random(seed)
    shared = [sentence(rng, rng.randrange(5, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a:], p[: a + 1], sentence(rng, rng.randrange(1, 30)), "é" * rng.randrange(1, 70)]))
        rows.append((i * 7 - 20, " ".join(parts)))
    return rows


def test_hostile_rows(spark):
    rows = [r for r in edge_texts() if r[0] not in (None, 21)]
    assert got(spark, rows, 100) == brute(rows, 100)
    assert suffix.removed_documents(empty_docs(spark)).count() == 0


@pytest.mark.parametrize(("seed", "length"), [(1, 100), (2, 100), (3, 40)])
def test_shared_passages(spark, seed, length):
    rows = passages(seed, 120)
    want = brute(rows, length)
    assert sum(w[1] for w in want.values()) > 1000
    assert got(spark, rows, length) == want


def test_hot_grams_and_many_names(spark, monkeypatch):
    rng = random.Random(9)
    passage = sentence(rng, 80)
    rows = [(i, sentence(rng, rng.randrange(0, 12)) + passage[: rng.randrange(100, len(passage))] + sentence(rng, rng.randrange(0, 12))) for i in range(150)]
    want = brute(rows, 100)
    assert got(spark, rows, 100) == want  # a gram in most documents is hot
    monkeypatch.setattr(suffix, "HOT_SHARE", 2.0)
    assert got(spark, rows, 100) == want  # nothing is hot
    monkeypatch.setattr(suffix, "MIXED_MAX", 3)
    assert got(spark, rows, 100) == want  # windows one by one


def test_parts_hold_each_window_once():
    text = sentence(random.Random(3), 60_000)
    assert len(text) > 300_000
    seen = []
    for rows, places, data, offsets in suffix.parts(pa.array(["short", text, None]), 100, 70_000):
        for k, (row, place) in enumerate(zip(rows, places, strict=True)):
            own = data[offsets[k] : offsets[k + 1]].tobytes()
            seen += [(row, place + i) for i in range(len(own) - 99)]
            assert own == ["short", text, ""][row].encode()[place : place + len(own)]
    assert seen == [(1, i) for i in range(len(text) - 99)]


def test_long_texts_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 50_000)
    rng = random.Random(4)
    passage = sentence(rng, 60)
    long = " ".join(sentence(rng, 3000) + passage for _ in range(20))
    assert len(long) > 300_000
    rows = [(1, passage + " before"), (2, long), (3, "x" + long[49_000:120_000]), (4, None)]
    assert got(spark, rows, 100) == brute(rows, 100)


def test_rows_of_one_id_and_null_id(spark):
    text = sentence(random.Random(1), 60)
    rows = [(1, text), (1, text), (2, text), (2, "other " + text), (None, text)]
    out = suffix.removed_documents(doc_frame(spark, rows)).collect()
    by = sorted((r["doc_id"] or 0, r["n_removed"]) for r in out)
    # the null id comes first, so every other copy is a repeat of it
    assert by[0] == (0, 0) and [b[1] for b in by[1:]] == [len(text)] * 4


def test_cleaned_rows_keep_the_other_columns(spark):
    text = sentence(random.Random(2), 60)
    rows = [(1, text), (2, "é" + text + " new"), (3, None), (4, "short")]
    docs = doc_frame(spark, rows)
    out = {r["doc_id"]: r for r in suffix.cleaned_rows(docs).collect()}
    assert suffix.cleaned_rows(docs).columns == docs.columns
    assert out[1]["text"] == text and out[2]["text"] == "é new" and out[3]["text"] is None and out[4]["text"] == "short"
    assert out[2]["kind"] == "k" and out[2]["score"] == 0.5


def test_earliest():
    a = np.array([5, 5, 5, 6, 5], np.uint64)
    b = np.array([1, 1, 1, 1, 2], np.uint64)
    first = suffix.earliest(a, b, np.array([3, 2, 2, 9, 9]), np.array([0, 7, 4, 0, 0]))
    assert first.tolist() == [False, False, True, True, True]
    assert suffix.earliest(a[:0], b[:0], a[:0].astype(int), a[:0].astype(int)).tolist() == []
