"""Order MinHash fingerprints with built-in functions.

A text's units are its words, but a word of over ``LONG_WORD`` code points gives its code points as
units, so a passage has the same units wherever it stands.  Each run of ``k`` units is numbered by its occurrence
among equal runs, so a run that comes twice counts as two elements.  Each numbered run gets a
hash; the hash space is cut into ``buckets`` ranges, the ``picks`` smallest elements of each range
are put back into text order, and the ordered tuple is hashed: one signature a range.  Moving,
inserting or deleting text changes the selected runs or their order, so equal signatures fall
with edit distance.

Defined results: null text counts as empty; a text without units has no signatures (fingerprint
``''``) and is like another such text with 1, like any other with 0; a text with fewer than ``k``
units is one run; equal texts have equal fingerprints; repeated rows are kept, ordered by
doc_id (null first) and then by a hash of the text; the edited text of the last document uses the
first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlease.llm.shared import stage_table

LONG_WORD = 24
#: Low bits of a packed long that hold a position; a text has fewer units than 2 ** 27.
POS_BITS = 27


def _packed(h: Column, pos: Column) -> Column:
    """36 hash bits above 27 position bits, never negative: sorts by hash, then by position."""
    return F.shiftleft(F.shiftrightunsigned(h, 28), POS_BITS).bitwiseOR(pos.cast("long"))


def with_signatures(df: DataFrame, text: str, out: str, k: int = 2, buckets: int = 32, picks: int = 2) -> DataFrame:
    """Add array column ``out``: one long for each hash range with elements, the range in its top bits.

    Every intermediate array is a column that its consumer reads at least twice, or that
    ``zip_with`` takes whole: the optimizer would move an array read once into the per-element
    function and build it anew for each element.
    """
    bits = buckets.bit_length() - 1
    if buckets != 1 << bits:
        raise ValueError("buckets must be a power of two")
    u, h, s, n = "__units", "__hash", "__sorted", "__numbered"
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn(u, words)
    spelled = F.flatten(F.transform(F.col(u), lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
    df = df.withColumn(u, F.when(F.exists(F.col(u), lambda w: F.length(w) > LONG_WORD), spelled).otherwise(F.col(u)))
    df = df.withColumn(h, F.transform(F.col(u), lambda w: F.xxhash64(w)))
    runs = F.greatest(F.size(h) - F.lit(k - 1), F.least(F.size(h), F.lit(1)))
    run_hash = lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(k)])
    places = F.when(runs > 0, F.sequence(F.lit(0), runs - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(s, F.sort_array(F.transform(places, lambda i: _packed(run_hash(i), i))))
    # equal runs stand together: lengths of the stretches give each run's occurrence number
    top = lambda x: F.shiftrightunsigned(x, POS_BITS)
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (top(F.get(F.col(s), i)) != top(F.get(F.col(s), i - 1))))
    df = df.withColumn("__starts", F.when(F.size(s) > 0, F.concat(starts, F.array(F.size(s)))).otherwise(F.array().cast("array<int>")))
    stretch = lambda i: F.sequence(F.lit(0), F.get(F.col("__starts"), i + 1) - F.get(F.col("__starts"), i) - 1)
    df = df.withColumn(
        "__occ",
        F.when(F.size("__starts") > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.size("__starts") - 2), stretch))).otherwise(F.array().cast("array<int>")),
    )
    mask = F.lit((1 << POS_BITS) - 1).cast("long")
    numbered = F.zip_with(F.col(s), F.col("__occ"), lambda x, o: _packed(F.xxhash64(top(x), o), x.bitwiseAND(mask)))
    df = df.withColumn(n, F.sort_array(numbered))
    range_of = lambda x: F.shiftrightunsigned(x, 63 - bits)
    lead = F.filter(F.col(n), lambda x, i: (i < picks) | (range_of(F.get(F.col(n), i - picks)) != range_of(x)))
    df = df.withColumn("__lead", lead)
    opens = F.filter(F.col("__lead"), lambda x, i: (i == 0) | (range_of(F.get(F.col("__lead"), i - 1)) != range_of(x)))
    low36 = F.lit((1 << (63 - POS_BITS)) - 1).cast("long")

    def signature(x: Column) -> Column:
        same = F.filter(F.col("__lead"), lambda y: range_of(y) == range_of(x))
        placed = F.sort_array(F.transform(same, lambda y: F.shiftleft(y.bitwiseAND(mask), 63 - POS_BITS).bitwiseOR(top(y))))
        tuple_hash = F.xxhash64(F.transform(placed, lambda y: y.bitwiseAND(low36)))
        return F.shiftleft(range_of(x), 63 - bits).bitwiseOR(F.shiftrightunsigned(tuple_hash, 1 + bits))

    df = df.withColumn(out, F.transform(opens, signature))
    return df.drop(u, h, s, "__starts", "__occ", n, "__lead")


def fingerprint_text(signatures: Column) -> Column:
    """The signatures as hex, one field a filled range; '' where there is none at all."""
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column, buckets: int = 32) -> Column:
    """Equal signatures over ranges that either text fills; 1 for two texts without any."""
    shift = 63 - (buckets.bit_length() - 1)
    ranges = lambda x: F.transform(x, lambda y: F.shiftrightunsigned(y, shift))
    used = F.size(F.array_union(ranges(a), ranges(b)))
    same = F.size(F.array_intersect(a, b))
    return F.when(used == 0, F.lit(1.0)).otherwise(same.cast("double") / used)


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], derived: list[str], rows_per_range: int = 1000) -> DataFrame:
    """doc_id, text, the columns that ``derive`` adds, and all but doc_id as ``next_*`` of the next document by ascending doc_id (after the last: the first).

    Documents are cut into ranges of doc_id: up to 512 quantile ranges, each cut evenly into finer
    ones as the table grows; rows without a doc_id are dealt by their text's hash.  A range is one
    window; the first document of the range after it closes the gap, so no task sees all documents.
    ``derive`` is run once a document, and once more on the first of each range.
    """
    carried = ["text", *derived]
    n = docs.count()
    coarse = int(max(1, min(512, n // rows_per_range)))
    fine = int(max(1, n // (coarse * rows_per_range)))
    edges = sorted(set(docs.approxQuantile("doc_id", [i / coarse for i in range(1, coarse)], 0.1 / coarse))) if coarse > 1 else []
    if edges:
        lit = F.array(*[F.lit(int(e)) for e in edges])
        docs = docs.withColumn("__coarse", F.size(F.filter(lit, lambda e: e <= F.col("doc_id"))))
        low, high = F.get(lit, F.col("__coarse") - 1), F.get(lit, F.col("__coarse"))
        inside = F.floor((F.col("doc_id") - low) * F.lit(fine) / F.greatest(high - low, F.lit(1)))
        docs = docs.withColumn("__fine", F.coalesce(F.least(F.greatest(inside, F.lit(0)), F.lit(fine - 1)), F.lit(0)))
    else:
        docs = docs.withColumns({"__coarse": F.lit(0), "__fine": F.lit(0).cast("long")})
    docs = docs.withColumn("__tie", F.xxhash64("text"))
    # rows without a doc_id come first, by their text's hash: its top bits deal them, its order is the ranges' order
    spread = F.least(F.floor((F.shiftright("__tie", 32) + (1 << 31)) * n / F.lit(rows_per_range * (1 << 32))), F.lit(n // rows_per_range))
    docs = docs.withColumns({"__coarse": F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("__coarse")), "__fine": F.when(F.col("doc_id").isNull(), spread).otherwise(F.col("__fine"))})
    ranges = ["__coarse", "__fine"]
    # a stage table, so that its size is known: the texts are not shuffled to meet a small one
    heads_of = docs.groupBy(*ranges).agg(F.min(F.struct("doc_id", "__tie")).alias("__head"))
    heads_of = stage_table(heads_of.select(*ranges, F.col("__head.doc_id").alias("__id"), F.col("__head.__tie").alias("__tie")), "fingerprint-ranges")
    match = [docs[c] == heads_of[c] for c in (*ranges, "__tie")] + [docs["doc_id"].eqNullSafe(heads_of["__id"])]
    first_rows = docs.join(heads_of, match, "left_semi").dropDuplicates([*ranges])
    firsts = derive(first_rows).select(*ranges, F.struct(*carried).alias("__own"))
    ordered = Window.partitionBy(*ranges).orderBy(F.col("doc_id").asc_nulls_first(), F.col("__tie").asc())
    inside = derive(docs).select("doc_id", *ranges, "__tie", F.struct(*carried).alias("__own")).withColumn("__next", F.lead("__own").over(ordered))
    # what follows a range: the first document of the finer range after it, else of the coarse range after it (at most 513), else of all
    finer = Window.partitionBy("__coarse").orderBy("__fine")
    heads = firsts.withColumns({"__after": F.lead("__own").over(finer), "__row": F.row_number().over(finer)})
    whole = Window.orderBy("__coarse").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.coalesce(F.lead("__own").over(Window.orderBy("__coarse")), F.first("__own").over(whole))
    turns = heads.where("__row = 1").select("__coarse", turn.alias("__turn"))
    closing = heads.join(turns, "__coarse").select("__coarse", "__fine", F.coalesce("__after", "__turn").alias("__closing"))
    joined = inside.join(closing, ["__coarse", "__fine"]).withColumn("__next", F.coalesce("__next", "__closing"))
    return joined.select("doc_id", *[F.col(f"__own.{c}").alias(c) for c in carried], *[F.col(f"__next.{c}").alias(f"next_{c}") for c in carried])


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``next_text``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(text.substr(F.lit(1), n - half), next_text.substr(F.lit(1), half))


def fingerprint_documents(docs: DataFrame, k: int = 2, buckets: int = 32, picks: int = 2) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likenesses."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, lambda d: with_signatures(d, "text", "sig", k, buckets, picks), ["sig"])
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).drop("next_text")
    rows = with_signatures(rows, "edited", "edited_sig", k, buckets, picks)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("sig")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig"), buckets).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig"), buckets).alias("near_next"),
    )
