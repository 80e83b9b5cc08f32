import hashlib
import re
import struct

import xxhash
from llm_cases import doc_frame, edge_texts, empty_docs

from fairlease.llm import omh

M = (1 << 64) - 1


def h_long(x, seed=42):
    return xxhash.xxh64_intdigest(struct.pack("<Q", x & M), seed)


def brute_signatures(text, k=2, bits=5, picks=2):
    units = [u for w in re.split(r"[\x20\x09-\x0D]+", text) if w for u in (w if len(w) > omh.LONG_WORD else [w])]
    hashes = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    runs = max(len(units) - k + 1, min(len(units), 1))
    seen, numbered = {}, []
    for i in range(runs):
        h = 42
        for x in hashes[i : i + k]:
            h = h_long(x, h)
        h >>= 28
        occ = seen[h] = seen.get(h, -1) + 1
        numbered.append((xxhash.xxh64_intdigest(struct.pack("<i", occ), h_long(h)) >> 28, i))
    out = []
    for b in range(1 << bits):
        own = sorted(x for x in numbered if x[0] >> (36 - bits) == b)[:picks]
        if own:
            t = 42
            for g, _ in sorted(own, key=lambda x: x[1]):
                t = h_long(g, t)
            out.append((b << (63 - bits)) | (t >> (1 + bits)))
    return out


def likeness(a, b):
    ranges = {x >> 58 for x in a} | {x >> 58 for x in b}
    return len(set(a) & set(b)) / len(ranges) if ranges else 1.0


def test_fingerprints_by_brute_force(spark):
    rows = [r for r in edge_texts() if r[0] is not None and r[0] != 21] + [(21, "one of a kind")]
    out = {r["doc_id"]: r for r in omh.fingerprint_documents(doc_frame(spark, rows)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(out) == len(order)
    for n, (i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (brute_signatures(x) for x in (text, edited, after))
        r = out[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == ".".join(f"{x:x}" for x in a)
        assert r["edited_fingerprint"] == ".".join(f"{x:x}" for x in b)
        assert abs(r["near_edited"] - likeness(a, b)) < 1e-12
        assert abs(r["near_next"] - likeness(a, c)) < 1e-12
    assert out[7]["fingerprint"] == out[10]["fingerprint"] and out[1]["fingerprint"] == out[2]["fingerprint"] == ""


def test_ranges_of_many_documents(spark):
    rows = [(i * i * 1000 if i % 2 else i, f"text number {i} " * 3) for i in range(400)]
    order = sorted(rows)
    got = {r["doc_id"]: r["next_text"] for r in omh.with_next(spark.createDataFrame(rows, "doc_id long, text string"), lambda d: d, [], rows_per_range=7).collect()}
    assert got == {i: order[(n + 1) % 400][1] for n, (i, _) in enumerate(order)}


def test_finer_ranges(spark):
    rows = [(i, f"t{i}") for i in range(3000)]
    got = {r["doc_id"]: r["next_text"] for r in omh.with_next(spark.createDataFrame(rows, "doc_id long, text string"), lambda d: d, [], rows_per_range=1).collect()}
    assert got == {i: f"t{(i + 1) % 3000}" for i in range(3000)}


def test_repeats_nulls_empty_and_order(spark):
    rows = [(None, "x y z"), (5, "p q"), (5, "p q"), (6, None)]
    out = omh.fingerprint_documents(doc_frame(spark, rows)).collect()
    assert len(out) == 4 and {r["fingerprint"] for r in out if r["doc_id"] == 5}.__len__() == 1
    assert omh.fingerprint_documents(empty_docs(spark)).count() == 0
    one = omh.fingerprint_documents(doc_frame(spark, [(1, "alone here")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_rows_without_an_id_are_dealt(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(i, f"t{i}") for i in range(40)]
    got = omh.with_next(spark.createDataFrame(rows, "doc_id long, text string"), lambda d: d, [], rows_per_range=10).collect()
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - ((h >> 63) << 64)
    order = [t for _, t in sorted((signed(t), t) for i, t in rows if i is None)] + [f"t{i}" for i in range(40)]
    assert {r["text"]: r["next_text"] for r in got} == {t: order[(n + 1) % 340] for n, t in enumerate(order)}


def test_a_passage_has_the_same_units_beside_long_words():
    passage = " ".join(f"w{i}" for i in range(300))
    long = "".join(chr(0x4E00 + i % 997) for i in range(100))
    a, b = brute_signatures(passage + " " + long), brute_signatures(passage + " short words only " * 30)
    assert likeness(a, b) > 0.1


def test_order_matters(spark):
    text = " ".join(f"w{i}" for i in range(400))
    swapped = " ".join([f"w{i}" for i in range(200, 400)] + [f"w{i}" for i in range(200)])
    a, b = brute_signatures(text), brute_signatures(swapped)
    assert likeness(a, b) < 0.8 < likeness(a, brute_signatures(text + " more"))
