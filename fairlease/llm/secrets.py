"""Secret scans: a trigram index chooses the texts that each rule's expression is run on.

A rule is a Java expression with a least length.  Its syntax tree gives a Boolean trigram query, a
set of trigram sets of which one must be in any matching text; a rule whose matches share no
trigram for sure (a bare character class) has no query and is run on every text.

*Index.* Rows get a number and are dealt into blocks of consecutive numbers.  The index holds, for
each block and each trigram that some query names, the posting list of the rows whose text holds
it, letter case aside.  *Search.* Each block's posting lists are intersected within a query's sets
and united over them.  *Verification.* Candidate rows go back to their texts, where the expression
itself decides; matches keep its leftmost, non-overlapping order, and failing ones (too short)
are dropped after they have taken their text, as a scanner would.  Built-in functions only.

No key holds more than a block of rows: blocks, row numbers and trigrams within a block are all
dealt evenly, whatever texts or ids repeat.  A text's matches are rows of a window over that text alone.

Defined results: null text counts as empty and has no spans; positions count code points, ends are
exclusive; spans of different kinds may overlap and are all kept; equal texts have equal spans;
repeated rows and null doc_ids are kept as rows of their own; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as rx
from re import _parser as rx_parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlease.llm.shared import stage_table

#: Rows of a block of the index.
BLOCK_ROWS = 4096
#: Strings that a part of an expression may stand for before it counts as open.
MOST_STRINGS = 64
MOST_CHOICES = 16


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java syntax without flags; ``least`` code points of group ``group`` make a match count."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        """A bare class finds the same long runs if it asks for the length itself."""
        bare = self.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", self.pattern)
        return ("(?i)" if self.any_case else "") + (f"{self.pattern[:-1]}{{{self.least},}}" if bare else self.pattern)


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Public shapes of keys and tokens, looked for beside the base kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9._~+/-]+=*)", 20, 1, any_case=True),
    Rule("login", r"://[A-Za-z0-9._-]+:([^\x20\x09-\x0D/@:]+)@", 3, 1),
)

Query = frozenset[frozenset[str]]  # one of the sets must be there whole


def _class_letters(items) -> set[str] | None:
    """The characters of a class; None where they are too many or not listed."""
    out: set[str] = set()
    for op, value in items:
        if op is rx.LITERAL:
            out.add(chr(value))
        elif op is rx.RANGE and value[1] - value[0] < MOST_STRINGS:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def _alternatives(tree) -> list[list[set[str] | None]]:
    """The ways through an expression; each way is a row of known strings, None where anything may stand."""
    ways: list[list[set[str] | None]] = [[]]
    for op, value in tree:
        if op is rx.LITERAL:
            here = [[{chr(value)}]]
        elif op is rx.IN and (letters := _class_letters(value)) is not None and len(letters) <= 8:
            here = [[letters]]
        elif op is rx.BRANCH:
            here = [way for branch in value[1] for way in _alternatives(branch)]
        elif op is rx.SUBPATTERN:
            here = _alternatives(value[3])
        elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT):
            low, high, inner = value
            once = _alternatives(inner)
            if (low, high) == (0, 1):
                here = [[{""}], *once]
            elif low == high and low <= 4:
                here = [[]]
                for _ in range(low):
                    here = [a + b for a in here for b in once]
            else:  # at least ``low`` of them, then anything
                here = [[*way, None] for way in once] if low else [[None]]
        elif op is rx.AT:
            continue
        else:
            here = [[None]]
        if len(ways) * len(here) > MOST_CHOICES:
            here = [[None]]
        ways = [a + b for a in ways for b in here]
    return ways


def _stretches(way: list[set[str] | None]) -> list[set[str]]:
    """The known strings between the open places of a way, each as the set of what may stand there."""
    out: list[set[str]] = [{""}]
    for part in way:
        if part is None:
            out.append({""})
        elif len(out[-1]) * len(part) <= MOST_STRINGS:
            out[-1] = {a + b for a in out[-1] for b in part}
        else:
            out.append(set(part))
    return out


def trigrams(s: str) -> frozenset[str]:
    """ASCII ones alone: other letters may change their number when they are lowered."""
    return frozenset(g for i in range(len(s) - 2) if (g := s[i : i + 3]).isascii())


def trigram_query(rule: Rule) -> Query | None:
    """Trigram sets of which a text with a match holds at least one; None where no trigram is sure.

    Letters are lowered; the index lowers the texts too.
    """
    out: set[frozenset[str]] = set()
    for way in _alternatives(rx_parser.parse(rule.pattern)):
        sets: set[frozenset[str]] = {frozenset()}
        for strings in _stretches(way):
            more = {trigrams(s.lower()) for s in strings}
            if frozenset() not in more and len(sets) * len(more) <= MOST_STRINGS:
                sets = {a | b for a in sets for b in more}
        if frozenset() in sets:
            return None
        out |= sets
    # a set with a smaller one inside adds nothing
    return frozenset(s for s in out if not any(o < s for o in out))


def posting_lists(rows: DataFrame, grams: Sequence[str]) -> DataFrame:
    """(block, gram, rows): the numbers of the block's rows whose lowered text holds the trigram."""
    low = rows.select("row_id", "block", F.lower("text").alias("low"))
    held = F.array(*[F.when(F.col("low").contains(g), F.lit(n)) for n, g in enumerate(grams)])
    found = low.select("row_id", "block", F.explode(F.array_compact(held)).alias("gram"))
    return found.groupBy("block", "gram").agg(F.collect_list("row_id").alias("rows"))


def candidates(postings: DataFrame, grams: Sequence[str], queries: dict[str, Query]) -> DataFrame:
    """(row_id, kinds): the rows that satisfy each kind's trigram query."""
    number = {g: n for n, g in enumerate(grams)}
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "rows"))).alias("lists"))
    none = F.array().cast("array<long>")
    posting = lambda g: F.coalesce(F.element_at("lists", F.lit(number[g])), none)
    parts = []
    for kind, query in queries.items():
        whole = [reduce(F.array_intersect, [posting(g) for g in sorted(s)]) for s in sorted(query, key=sorted)]
        parts.append(F.struct(F.lit(kind).alias("kind"), reduce(F.array_union, whole).alias("rows")))
    kinds = lists.select(F.explode(F.array(*parts)).alias("part"))
    return kinds.select(F.explode("part.rows").alias("row_id"), F.col("part.kind").alias("kind")).groupBy("row_id").agg(F.collect_set("kind").alias("kinds"))


def _matches(text: Column, rule: Rule) -> Column:
    """(gap, size, counts) of each match in order: code points since the match before, its own, whether it is long enough."""
    gaps = F.split(text, rule.java, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    judged = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group))
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("own"), judged.alias("judged"))
    return F.transform(
        F.filter(zipped, lambda m: m["own"].isNotNull()),
        lambda m: F.struct(
            F.lit(rule.kind).alias("kind"), F.length(m["gap"]).cast("long").alias("gap"), F.length(m["own"]).cast("long").alias("size"), (F.length(m["judged"]) >= rule.least).alias("counts")
        ),
    )


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id and ``spans`` (start, rank of the kind, end, kind), by start, then by the rules' order: one row for each row of ``docs``."""
    queries = {r.kind: trigram_query(r) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    grams = sorted({g for q in indexed.values() for s in q for g in s})
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = stage_table(rows.withColumn("block", F.expr(f"row_id div {int(block_rows)}")), "secret-rows")
    if indexed:
        chosen = stage_table(candidates(posting_lists(rows, grams), grams, indexed), "secret-candidates")
        looked = rows.join(chosen, "row_id", "left")
    else:
        looked = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    no_match = F.array().cast("array<struct<kind:string,gap:long,size:long,counts:boolean>>")
    scanned = []
    for r in rules:
        runs_here = F.array_contains("kinds", r.kind) if r.kind in indexed else F.col("text").rlike(r.java)
        scanned.append(F.when(F.coalesce(runs_here, F.lit(False)), _matches(F.col("text"), r)).otherwise(no_match))
    found = looked.select("row_id", F.posexplode(F.concat(*scanned)).alias("at", "m")).select("row_id", "at", "m.*")
    before = Window.partitionBy("row_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).where("counts")
    span = F.struct((F.col("end") - F.col("size")).alias("start"), rank.alias("rank"), F.col("end"), F.col("kind"))
    spans = placed.groupBy("row_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    return rows.select("row_id", "doc_id").join(spans, "row_id", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per document the base kinds' counts, the checksum of their spans, and all spans."""
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
