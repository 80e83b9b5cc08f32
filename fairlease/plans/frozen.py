"""A valuation whose fitted parts are given numbers, so that SQL can follow it to the last column.

Everything that a fit would find (model, centres, isolation trees) is written down here; everything
that is computed from the tables (lookups, interval widths, ranks of the reference) is computed by
the library's own operators.  ``VALUATION_SQL`` says the same in SQL.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlease.operators import anomaly, lookup, models
from fairlease.operators.rank_index import build_rank_index
from fairlease.plans.valuation import CONFIDENCE, RANKED, Artifacts
from fairlease.session import materialize

AREA, ROOMS, MEDIAN = "coalesce(area_m2_clean, 0.0)", "coalesce(room_count_clean, 0.0)", "coalesce(rent_deposit_median_log, 0.0)"
#: The learner, the three scaled features, their centres and what becomes of each cluster.
PREDICTION = f"0.1 + 0.004 * {AREA} + 0.02 * {ROOMS}"
FEATURES = (f"{AREA} / 100.0", f"{ROOMS} / 3.0", f"{MEDIAN} / 20.0")
CENTERS = ((0.1, 0.5, 0.9), (0.6, 1.2, 0.9), (1.2, 2.0, 0.8), (0.3, 1.9, 0.0))
MERGED = (0, 1, 2, 2)
#: Two isolation trees over those features: (node, feature, threshold, left, right, size, depth).
TREES = (
    ((0, 0, 0.55, 1, 2, 128, 0), (1, -1, 0.0, -1, -1, 100, 1), (2, 1, 1.4, 3, 4, 28, 1), (3, -1, 0.0, -1, -1, 20, 2), (4, -1, 0.0, -1, -1, 8, 2)),
    ((0, 2, 0.93, 1, 2, 128, 0), (1, -1, 0.0, -1, -1, 60, 1), (2, -1, 0.0, -1, -1, 68, 1)),
)
PSI, OFFSET = 128, -0.5


def frozen_artifacts(flagged: DataFrame, labelled: DataFrame) -> Artifacts:
    """``labelled``: training rows with ``target`` and ``split``; lookups, widths and ranks come from the rows."""
    spark = flagged.sparkSession
    model = PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {PREDICTION} AS prediction FROM __THIS__")])
    design = PipelineModel(
        stages=[
            SQLTransformer(statement="SELECT *, " + ", ".join(f"{f} AS f{i}__imp" for i, f in enumerate(FEATURES)) + " FROM __THIS__"),
            VectorAssembler(inputCols=[f"f{i}__imp" for i in range(len(FEATURES))], outputCol="features"),
        ]
    )
    residual = model.transform(labelled.where("split = 'valid'")).withColumn("abs_residual", F.abs(F.col("target") - F.col("prediction")))
    intervals = materialize(lookup.build_interval_lookup(residual, "abs_residual", alpha=1 - CONFIDENCE))
    medians = materialize(lookup.build_median_lookup(flagged, "rent_deposit_median"))
    display = {m: str(i + 1) for i, m in enumerate(sorted(set(MERGED)))}
    clusters = spark.createDataFrame([(k, m, display[m]) for k, m in enumerate(MERGED)], "raw_cluster int, merged_cluster int, display_cluster string")
    nodes = pd.DataFrame([(t, *n, PSI) for t, tree in enumerate(TREES) for n in tree], columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth", "n_sample"])
    forest = anomaly.IsolationForestModel(nodes, PSI, OFFSET)
    ucols = [*anomaly.UNSUP_CAT, *anomaly.UNSUP_NUM]
    train = anomaly.unsupervised_frame(labelled.where("split = 'train'"))
    ref = design.transform(models.categorical_frame(train, ucols, anomaly.UNSUP_CAT, anomaly.UNSUP_NUM, keep=["row_key"])).select("row_key", "features")
    ref = anomaly.centroid_distance(ref, CENTERS, "features", None, "raw_distance").join(F.broadcast(clusters), F.col("cluster") == F.col("raw_cluster"))
    ref = forest.score_frame(anomaly.centroid_distance(ref, CENTERS, "features", "merged_cluster"), "features")
    meta = {"confidence_level": CONFIDENCE, "features": ["property_type", "area_m2_clean", "room_count_clean"], "cat_cols": ["property_type"], "num_cols": ["area_m2_clean", "room_count_clean"]}
    stats = spark.createDataFrame([], "merged_cluster int, distance_median double")
    return Artifacts(model, medians, intervals, design, [list(c) for c in CENTERS], clusters, stats, forest, build_rank_index(materialize(ref.select(*RANKED)), RANKED), meta)


def _distance(center) -> str:
    return "sqrt(" + " + ".join(f"(x{i} - {v}) * (x{i} - {v})" for i, v in enumerate(center)) + ")"


def _leaf(size: int, depth: int) -> float:
    return depth + (2.0 * (math.log(size - 1.0) + 0.5772156649015329) - 2.0 * (size - 1.0) / size if size > 2 else float(size == 2))


def _path(tree, node: int = 0) -> str:
    _, feature, cut, left, right, size, depth = tree[node]
    return repr(_leaf(size, depth)) if feature < 0 else f"case when x{feature} < {cut} then {_path(tree, left)} else {_path(tree, right)} end"


def _scored(table: str) -> str:
    """Features, clusters and the two scores of ``table``'s rows (m: the log lease median)."""
    xs = ", ".join(f.replace("rent_deposit_median_log", "m") + f" x{i}" for i, f in enumerate(FEATURES))
    raw = f"list_position([{', '.join(_distance(c) for c in CENTERS)}], least({', '.join(_distance(c) for c in CENTERS)})) - 1"
    merged = "case raw " + " ".join(f"when {k} then {m}" for k, m in enumerate(MERGED)) + " end"
    own = "case merged " + " ".join(f"when {m} then {_distance(CENTERS[m])}" for m in sorted(set(MERGED))) + " end"
    length = " + ".join(_path(t) for t in TREES)
    return (
        f"select *, {own} kd, pow(2.0, -(({length}) / {len(TREES)}.0) / {_leaf(PSI, 0)!r}) + ({OFFSET}) iso from (select *, {merged} merged from (select *, {raw} raw from"
        f" (select *, {xs} from (select *, ln(1 + greatest(rent_deposit_median, 0)) m from {table}))))"
    )


def _bands(value: str, bands) -> str:
    return f"case when {value} is null then null " + " ".join(f"when {value} >= {cut} then '{label}'" if cut is not None else f"else '{label}'" for cut, label in bands) + " end"


def valuation_sql(medians: str, median_joins: str, median_value: str, median_source: str, grades, risks) -> str:
    """Body after the ``flagged`` and ``sp`` tables; the medians' pieces are those of the lookup's own query."""
    display = {m: str(i + 1) for i, m in enumerate(sorted(set(MERGED)))}
    shown = "case merged " + " ".join(f"when {m} then '{d}'" for m, d in display.items()) + " end"
    return f"""
, {medians},
asked as materialized (select *, coalesce(gu_name, '__MISSING__') k_gu_name, coalesce(property_type, '__MISSING__') k_property_type, coalesce(ym, '__MISSING__') k_ym from flagged),
filled as materialized (select a.* replace ({median_value} as rent_deposit_median), {median_source} src from asked a cross join mg {median_joins}),
vr as materialized (select gu_name, property_type, abs(target - ({PREDICTION})) r from (select f.*, sp.target from flagged f join sp using (row_key) where sp.split = 'valid')),
i0 as materialized (select gu_name, property_type, quantile_cont(r, {CONFIDENCE}) q from vr group by all having count(*) >= 30),
i1 as materialized (select property_type, quantile_cont(r, {CONFIDENCE}) q from vr group by all having count(*) >= 30),
i2 as materialized (select gu_name, quantile_cont(r, {CONFIDENCE}) q from vr group by all having count(*) >= 30),
iq as materialized (select quantile_cont(r, {CONFIDENCE}) q from vr),
trained as (select f.* from flagged f join sp using (row_key) where sp.split = 'train'),
ref as materialized ({_scored("trained")}),
tails as materialized (select quantile_cont(kd, 0.85) kn, quantile_cont(kd, 0.999) kh, quantile_cont(iso, 0.85) sn, quantile_cont(iso, 0.999) sh from ref),
kr as materialized (select kd v, sum(count(*)) over (order by kd) / (select count(*) from ref) p from ref group by kd),
sr as materialized (select iso v, sum(count(*)) over (order by iso) / (select count(*) from ref) p from ref group by iso),
scored as materialized ({_scored("filled")}),
ranked as (select s.*, coalesce(kr.p, 0) kp, coalesce(sr.p, 0) ip from scored s asof left join kr on s.kd >= kr.v asof left join sr on s.iso >= sr.v),
tailed as (
  select *, case when kh <= kn then 100 * kp else least(greatest((kd - kn) / (kh - kn) * 100, 0), 100) end kt,
    case when sh <= sn then 100 * ip else least(greatest((iso - sn) / (sh - sn) * 100, 0), 100) end st from ranked, tails
),
predicted as (
  select a.*, {PREDICTION} p, coalesce(i0.q, i1.q, i2.q, iq.q) q,
    case when i0.q is not null then '지역+주택구분' when i1.q is not null then '주택구분' when i2.q is not null then '지역' else '전체 중위값' end isrc
  from tailed a cross join iq left join i0 on a.k_gu_name = i0.gu_name and a.k_property_type = i0.property_type
  left join i1 on a.k_property_type = i1.property_type left join i2 on a.k_gu_name = i2.gu_name
),
priced as (select *, rent_deposit_median * (exp(p) - 1) fair, rent_deposit_median * (exp(p - q) - 1) low, rent_deposit_median * (exp(p + q) - 1) up from predicted),
judged as (select *, deposit_won / nullif(fair, 0) fr, deposit_won / nullif(up, 0) ur from priced),
final as (
  select *, greatest(coalesce(least(greatest((fr - 1.05) / 0.25 * 100, 0.0), 100.0), 0.0), coalesce(least(greatest((0.85 - fr) / 0.30 * 100, 0.0), 100.0), 0.0),
    coalesce(least(greatest((ur - 1.0) / 0.20 * 100, 0.0), 100.0), 0.0)) over_score, least(greatest(0.55 * kt + 0.45 * st, 0), 100) an from judged
)
select row_key, rent_deposit_median, src rent_deposit_median_source, round(p, 9) predicted_log_ratio, round(q, 9) interval_q, isrc interval_source,
  round(fair, 0) predicted_fair_deposit_won, round(low, 0) fair_deposit_lower_95_won, round(up, 0) fair_deposit_upper_95_won, {shown} cluster_id,
  round(kd, 9) kmeans_distance, round(iso, 9) isolation_score, round(an, 6) anomaly_percentile, round(over_score, 6) overprice_score,
  case when property_type in ('apt', 'rh', 'officetel', 'detached') then 'in_domain' else 'out_of_domain' end model_scope_status,
  {_bands("least(greatest(over_score, 0), 100)", risks)} risk_label, {_bands("over_score", grades)} price_risk_grade, {_bands("an", grades)} anomaly_grade
from final
"""
