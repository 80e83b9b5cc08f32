import random
import re
import zlib
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from llm_cases import doc_frame, edge_texts, empty_docs

from fairlease.llm import spelling

LOW = str.maketrans(ascii_uppercase, ascii_lowercase)


def brute_words(rows, least_length=7, least_count=2, every=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    if len(a) + 1 != len(b):
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def brute_variants(rows):
    n = brute_words(rows)
    words = sorted(n)
    near = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variant_rows(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgéèçß") for _ in range(rng.randrange(6, 12))) for _ in range(25)]
    base += ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "÷÷×÷×÷÷", "ÿÿÿÿÿÿÿÿ", "zzzzzzzy", "zzzzzzzz", "zzzzzzyz", "x" * 64, "x" * 65, "x" * 66, "x" * 64 + "y", "q" * 3000, "q" * 2999 + "r"]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rng.randrange(1, 60)):
            w = base[min(int(rng.expovariate(0.25)), len(base) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k + 1 :], w[:k] + rng.choice("abz") + w[k:]])
            words.append(rng.choice([w, w, w.upper() if "ß" not in w and "ÿ" not in w else w]))
        rows.append((i, " ".join(words)))
    return rows + [(1000, "chainab " * 300 + "chainabc " * 30 + "chainabcd " * 3)]


def collected(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=lambda r: r[0])


def test_variants_by_brute_force(spark):
    rows = variant_rows() + [r for r in edge_texts() if r[0] != 17]
    want = brute_variants(rows)
    assert collected(spelling.spelling_variants(doc_frame(spark, rows))) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] is not None and r[1] != r[2] for r in want)


def test_several_passes_find_the_same(spark):
    rows = variant_rows(9)
    assert collected(spelling.spelling_variants(doc_frame(spark, rows), pass_bytes=400)) == brute_variants(rows)


def test_probes_reach_every_pair():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(8)) for _ in range(60)})
    letters = np.array([list(w.encode("latin-1")) for w in words], np.uint8)
    layout = spelling.Layout({8: len(words)}, 1)
    filters = np.zeros(layout.size, np.uint64)
    _, block, mask = layout.place(spelling._terms(letters, 1).sum(1, dtype=np.uint64), 8)
    np.bitwise_or.at(filters, block, mask)
    found = [(words[r], k) for rows, keys in spelling.passing_edits(letters, layout, filters, 0) for r, k in zip(rows, keys)]
    pairs = {(a, b) for a, b in found if b in words}
    assert len(found) == len(set(found))
    assert pairs == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "deposit deposit"), (None, "deposit"), (3, None), (4, ""), (5, "a bb ccc")]
    got = collected(spelling.spelling_variants(doc_frame(spark, rows)))
    assert got == brute_variants(rows) and len(got) == 1
    assert spelling.spelling_variants(empty_docs(spark)).count() == 0
