"""Exact group quantiles that stay correct and balanced when one group is huge.

Two strategies share one output contract (``keys`` + one column per spec):

* ``"hash"``   — Spark's exact ``percentile`` aggregate.  One shuffle with map-side
  partial aggregation; each group's value->count map is merged in one reducer, so
  memory grows with the distinct values of the largest group.  Right for lookup
  and stats tables with many small groups.
* ``"sorted"`` — range-partition on ``(keys, value)`` so even a group holding a
  third of all rows is spread over many tasks; ranks come from per-partition
  counts (a table of at most #groups + #partitions rows), and only the two
  rows that bracket each requested rank are fetched.  Exact, linear
  interpolation identical to ``percentile``.
* ``"approx"`` — ``percentile_approx`` (bounded sketch) for callers that accept
  rank error.

:func:`weighted_percentiles` does the same for (keys, value, weight) tables: a group of many distinct
values is cut into value ranges, and prefix sums of weights tell which range holds a rank.

Spark broadcasts the small sides by their measured size in bytes; no hint is given by row count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlease.functions.columns import nan_to_null

Spec = tuple[str, str, float]  # (output column, value column, probability)

HOT_GROUP_ROWS = 1_000_000  # groups above this go to the sorted (split) path


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` matching NULL to NULL (pandas ``merge`` semantics); right key copies dropped."""
    if not keys:
        return left.crossJoin(right)
    keyset = set(keys)
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keyset else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    specs: Sequence[Spec],
    strategy: str = "auto",
    accuracy: int = 100_000,
    hot_rows: int = HOT_GROUP_ROWS,
    group_sizes: DataFrame | None = None,
) -> DataFrame:
    """One row per group present in ``df`` with one exact percentile per spec (NULL when all values are NULL).

    ``auto`` counts rows per group (a cheap partial aggregate), sends groups above
    ``hot_rows`` to the sorted path and all others to the hash aggregate.
    """
    keys = list(keys)
    if strategy == "auto":
        if not keys:
            n = df.count()
            return group_percentiles(df, keys, specs, "hash" if n <= hot_rows else "sorted")
        # ``group_sizes`` (keys + _gn) lets a caller that already counted rows per group skip this pass
        sizes = group_sizes if group_sizes is not None else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gn"))
        hot = sizes.filter(F.col("_gn") > hot_rows).select(*keys)
        if hot.isEmpty():
            return group_percentiles(df, keys, specs, "hash")
        cold_part = _null_safe_join(df, hot, keys, "left_anti")
        hot_part = _null_safe_join(df, hot, keys, "left_semi")
        return group_percentiles(cold_part, keys, specs, "hash").unionByName(
            group_percentiles(hot_part, keys, specs, "sorted")
        )
    if strategy == "hash":
        # one value map a column, whatever the number of its percentiles
        asked: dict[str, list[float]] = {}
        for _, c, p in specs:
            asked.setdefault(c, []).append(float(p))
        held = {c: f"__pct{i}" for i, c in enumerate(asked)}
        found = df.groupBy(*keys).agg(*[F.percentile(nan_to_null(c), F.array(*map(F.lit, ps))).alias(held[c]) for c, ps in asked.items()])
        return found.select(*keys, *[F.col(held[c])[asked[c].index(float(p))].alias(o) for o, c, p in specs])
    if strategy == "approx":
        aggs = [F.percentile_approx(nan_to_null(c), float(p), accuracy).cast("double").alias(o) for o, c, p in specs]
        return df.groupBy(*keys).agg(*aggs)
    if strategy != "sorted":
        raise ValueError(f"unknown strategy {strategy!r}")
    return _sorted_percentiles(df, keys, specs)


def _sorted_percentiles(df: DataFrame, keys: list[str], specs: Sequence[Spec]) -> DataFrame:
    from fairlease.session import cut_lineage

    measures = sorted({c for _, c, _ in specs})
    mid = {c: i for i, c in enumerate(measures)}
    gk = keys + ["_m"]
    # long form: one (keys, measure, value) row per non-null value
    long = (
        df.select(
            *keys,
            F.explode(
                F.array(*[F.struct(F.lit(mid[c]).alias("_m"), nan_to_null(F.col(c).cast("double")).alias("_v")) for c in measures])
            ).alias("_kv"),
        )
        .select(*keys, "_kv._m", "_kv._v")
        .filter(F.col("_v").isNotNull())
    )
    nparts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        long.repartitionByRange(nparts, *[F.col(k).asc_nulls_first() for k in gk], F.col("_v"))
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in gk], "_v")
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # ids are position-dependent: pin them with a reliable checkpoint before reuse
    ordered = cut_lineage(ordered)
    seg = ordered.groupBy(*gk, F.shiftrightunsigned("_id", 33).alias("_pid")).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_cnt")
    )
    wg = Window.partitionBy(*gk)
    seg = seg.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(wg.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_n", F.sum("_cnt").over(wg))
    # requested positions per measure
    asked = F.array(*[F.struct(F.lit(i).alias("_spec"), F.lit(mid[c]).alias("_m"), F.lit(float(p)).alias("_p")) for i, (_, c, p) in enumerate(specs)])
    tgt = seg.select("*", F.explode(F.filter(asked, lambda a: a["_m"] == F.col("_m"))).alias("_a")).select(*seg.columns, "_a._spec", "_a._p").withColumn("_pos", (F.col("_n") - 1) * F.col("_p"))
    tgt = tgt.select(
        "*",
        F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_rank"),
    ).filter((F.col("_rank") >= F.col("_off")) & (F.col("_rank") < F.col("_off") + F.col("_cnt")))
    tgt = tgt.select(*gk, "_spec", "_pos", "_rank", (F.col("_first") + F.col("_rank") - F.col("_off")).alias("_id"))
    vals = ordered.select("_id", "_v")
    hit = vals.join(tgt, "_id")
    gk_spec = keys + ["_spec"]
    per = hit.groupBy(*gk_spec).agg(
        F.first("_pos").alias("_pos"),
        F.min_by("_v", "_rank").alias("_lo"),
        F.max_by("_v", "_rank").alias("_hi"),
    )
    lo = F.floor("_pos")
    hi = F.ceil("_pos")
    per = per.withColumn(
        "_q",
        F.when(lo == hi, F.col("_lo")).otherwise((hi - F.col("_pos")) * F.col("_lo") + (F.col("_pos") - lo) * F.col("_hi")),
    )
    wide = per.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_spec") == i, F.col("_q"))).alias(o) for i, (o, _, _) in enumerate(specs)]
    )
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    if not keys:
        return groups.crossJoin(wide) if wide.columns else groups
    return _null_safe_join(groups, wide, keys)


# Weighted values ----------------------------------------------------------------
def _between(lo_rank, hi_rank, pos, lo, hi):
    """Linear interpolation at ``pos`` between the values of its two ranks."""
    return F.when(lo_rank == hi_rank, lo).otherwise((hi_rank - pos) * lo + (pos - lo_rank) * hi)


def weighted_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, specs: Sequence[tuple[str, float]], hot_rows: int = HOT_GROUP_ROWS, rows: int | None = None
) -> DataFrame:
    """Exact percentiles (output, probability) of ``value`` per group, each value counted ``weight`` times (a positive
    whole number): the numbers that ``percentile(value, p, weight)`` gives.  NULL values are skipped; a group of them
    alone has no row.

    Groups of over ``hot_rows`` rows are split by value over tasks.  ``rows``: the table's row count, if the caller
    knows it (up to ``hot_rows`` no group can be over).
    """
    keys = list(keys)
    known = df.where(nan_to_null(value).isNotNull())
    aggregate = lambda d: d.groupBy(*keys).agg(*[F.percentile(F.col(value), float(p), F.col(weight)).alias(o) for o, p in specs])
    some = lambda d: d if keys else d.where(F.col(specs[0][0]).isNotNull())  # noqa: E731  a table without rows has no group
    if (known.count() if rows is None else rows) <= hot_rows:
        return some(aggregate(known))
    if not keys:
        return _split_percentiles(known.withColumn("_all", F.lit(0)), ["_all"], value, weight, specs).drop("_all")
    hot = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gn")).where(F.col("_gn") > hot_rows).select(*keys)
    if hot.isEmpty():
        return aggregate(known)
    cold = aggregate(_null_safe_join(known, hot, keys, "left_anti"))
    return cold.unionByName(_split_percentiles(_null_safe_join(known, hot, keys, "left_semi"), keys, value, weight, specs))


def _split_percentiles(df: DataFrame, keys: list[str], value: str, weight: str, specs: Sequence[tuple[str, float]]) -> DataFrame:
    """Value ranges of each group; which range holds a rank is read from their weights, and only those ranges are summed up."""
    from fairlease.session import cut_lineage

    spark = df.sparkSession
    values = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.sum(weight).cast("long").alias("_w"))
    order = [F.col(k).asc_nulls_first() for k in keys]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # range bounds are sampled anew whenever the plan runs: pin the ranges before they are read twice
    ranged = cut_lineage(values.repartitionByRange(parts, *order, F.col("_v")).withColumn("_part", F.spark_partition_id()))
    ranges = ranged.groupBy(*keys, "_part").agg(F.sum("_w").alias("_held"))  # a row a group and range
    group = Window.partitionBy(*keys)
    ranges = ranges.withColumns(
        {"_before": F.coalesce(F.sum("_held").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_held").over(group)}
    )
    asked = F.array(*[F.struct(F.lit(i).alias("_spec"), ((F.col("_n") - 1) * F.lit(float(p))).alias("_pos")) for i, (_, p) in enumerate(specs)])
    wanted = ranges.select("*", F.explode(asked).alias("_q")).select("*", "_q.*").drop("_q")
    wanted = wanted.select(*keys, "_part", "_before", "_spec", "_pos", F.explode(F.array(F.struct(F.lit(0).alias("_end"), F.floor("_pos").alias("_rank")), F.struct(F.lit(1).alias("_end"), F.ceil("_pos").alias("_rank")))).alias("_r"), "_held")
    wanted = wanted.select(*keys, "_part", "_before", "_spec", "_pos", "_r.*", "_held").where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_held")))
    # prefix sums inside the ranges that hold a rank: a window never leaves one range
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = _null_safe_join(ranged, wanted.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi").withColumn("_upto", F.sum("_w").over(inside))
    hit = _null_safe_join(wanted, held, [*keys, "_part"], "inner").where((F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_w")) & (F.col("_rank") < F.col("_before") + F.col("_upto")))
    per = hit.groupBy(*keys, "_spec").agg(F.first("_pos").alias("_pos"), *[F.max(F.when(F.col("_end") == e, F.col(c))).alias(f"{c}{e}") for e in (0, 1) for c in ("_rank", "_v")])
    q = _between(F.col("_rank0"), F.col("_rank1"), F.col("_pos"), F.col("_v0"), F.col("_v1"))
    return per.withColumn("_q", q).groupBy(*keys).agg(*[F.max(F.when(F.col("_spec") == i, F.col("_q"))).alias(o) for i, (o, _) in enumerate(specs)])


#: Rank error of the sketch that narrows a percentile down is a row in so many; the range kept around it is three errors wide on each side.
NARROWED = 10_000


def _narrowed_percentiles(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Exact whole-table percentiles without a shuffle of the rows: a sketch gives a narrow value range around each one, one
    pass counts the rows below and inside, and only the values inside are grouped and ranked.

    A percentile whose ranks lie outside its range is found by :func:`_sorted_percentiles`.
    """
    from fairlease.session import materialize

    cols = list(dict.fromkeys(c for _, c, _ in specs))
    df = materialize(df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols]))  # read three times, whatever it comes from
    margin = 3.0 / NARROWED
    probs = {c: sorted({x for _, m, p in specs if m == c for x in (max(p - margin, 0.0), min(p + margin, 1.0))}) for c in cols}
    aggs = [x for j, c in enumerate(cols) for x in (F.count(c).alias(f"n{j}"), F.percentile_approx(c, F.array(*map(F.lit, probs[c])), NARROWED).alias(f"e{j}"))]
    found = df.agg(*aggs).first()
    ranges = {}  # spec -> lowest, highest value; a column without values has none
    for i, (_, c, p) in enumerate(specs):
        edges = found[f"e{cols.index(c)}"]
        if edges:
            ranges[i] = tuple(edges[probs[c].index(x)] for x in (max(p - margin, 0.0), min(p + margin, 1.0)))
    inside = {i: F.col(specs[i][1]).between(F.lit(lo), F.lit(hi)) for i, (lo, hi) in ranges.items()}
    held = df.agg(F.count(F.lit(1)).alias("rows"), *[x for i, (lo, _) in ranges.items() for x in (F.count_if(F.col(specs[i][1]) < F.lit(lo)).alias(f"b{i}"), F.count_if(inside[i]).alias(f"h{i}"))]).first()
    pos = {i: (found[f"n{cols.index(specs[i][1])}"] - 1) * float(specs[i][2]) for i in ranges}
    ends = {i: (math.floor(pos[i]), math.ceil(pos[i])) for i in ranges}
    missed = [s for i, s in enumerate(specs) if i in ranges and not held[f"b{i}"] <= ends[i][0] <= ends[i][1] < held[f"b{i}"] + held[f"h{i}"]]
    ranges = {i: r for i, r in ranges.items() if specs[i] not in missed}
    outs = [o for o, _, _ in specs]
    if not ranges:
        out = _sorted_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], specs).drop("_all")
        return materialize(out.select(*outs))
    entry = lambda i: F.struct(F.lit(i).alias("_spec"), F.col(specs[i][1]).alias("_v"), inside[i].alias("_in"))
    values = df.where(reduce(lambda a, b: a | b, [inside[i] for i in ranges])).select(F.explode(F.array(*map(entry, ranges))).alias("_e")).where("_e._in")
    values = values.groupBy("_e._spec", "_e._v").agg(F.count(F.lit(1)).alias("_w"))
    # at most 6 rows in NARROWED of the table, and one for each value at that
    values = values.withColumn("_upto", F.sum("_w").over(Window.partitionBy("_spec").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = lambda i, rank: F.max(F.when((F.col("_spec") == i) & (F.col("_upto") > rank - held[f"b{i}"]) & (F.col("_upto") - F.col("_w") <= rank - held[f"b{i}"]), F.col("_v")))
    ranked = values.agg(*[at(i, ends[i][e]).alias(f"_{e}_{i}") for i in ranges for e in (0, 1)])
    q = lambda i: _between(F.lit(ends[i][0]), F.lit(ends[i][1]), F.lit(pos[i]), F.col(f"_0_{i}"), F.col(f"_1_{i}"))
    out = ranked.select(*[(q(i) if i in ranges else F.lit(None).cast("double")).alias(o) for i, o in enumerate(outs)])
    if missed:
        rest = _sorted_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], missed).drop("_all")
        out = out.drop(*[o for o, _, _ in missed]).crossJoin(rest).select(*outs)
    return materialize(out)


def global_percentiles(df: DataFrame, specs: Sequence[Spec], strategy: str = "auto", hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """One-row table of whole-table percentiles (no keys); ``narrowed``, beyond ``hot_rows`` rows, moves only the values
    around each percentile."""
    if strategy == "auto":
        strategy = "hash" if df.count() <= hot_rows else "narrowed"
    if strategy == "narrowed":
        return _narrowed_percentiles(df, specs)
    if strategy in ("hash", "approx"):
        return group_percentiles(df, [], specs, strategy)
    out = _sorted_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], specs)
    return out.drop("_all")
