"""Registered queries over the test tables, with the SQL of each where SQL can
say it.  Values are rounded after every decision has been made."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posekeel.config import FEATURES, QCConfig
from posekeel.functions import geometry as g
from posekeel.functions.columns import dot, round_half_up
from posekeel.operators import agreement, edits, embeddings, explain, features, flags, frame_checks, labels, reports, structure, svm, zscore
from posekeel.plans.engine import Run
from posekeel.plans.pose_view import CHAIN, FRAME, FRAMES_SQL, HEIGHT, INSTANCES_SQL, KEY, WIDTH, N, derived, held
from posekeel.sinks import exports
from posekeel.sources import tables
from posekeel.streaming import rescore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ------------------------------------------------------------- frame checks

COUNTS = f"""frames AS {FRAMES_SQL}, inst AS {INSTANCES_SQL},
counts AS (SELECT f.video_idx, f.frame_idx, f.is_negative, count(i.inst_idx) AS n FROM frames f LEFT JOIN inst i USING (video_idx, frame_idx) GROUP BY ALL),
expected AS (SELECT v.video_idx, floor(coalesce(o.m, a.m) + 0.5) AS expected_count, coalesce(o.a, a.a) AS mean_count
 FROM (SELECT DISTINCT video_idx FROM counts) v
 LEFT JOIN (SELECT video_idx, median(n) AS m, avg(n) AS a FROM counts WHERE n > 0 GROUP BY video_idx) o USING (video_idx)
 CROSS JOIN (SELECT median(n) AS m, avg(n) AS a FROM counts WHERE n > 0) a)"""


@query(
    f"""WITH {COUNTS} SELECT video_idx, CAST(expected_count AS BIGINT) AS expected_count, round(any_value(mean_count), 4) AS mean_count, count(*) AS n_frames,
    count(*) FILTER (WHERE NOT is_negative AND n <> expected_count) AS n_wrong, count(*) FILTER (WHERE NOT is_negative AND n = 0) AS n_empty
    FROM counts JOIN expected USING (video_idx) GROUP BY video_idx, expected_count"""
)
def count_expected_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.count_check(frame_checks.frame_table(derived(spark, sf_dir)))
    return rounded(
        got.groupBy("video_idx", "expected_count").agg(
            F.first("mean_count").alias("mean_count"), F.count(F.lit(1)).alias("n_frames"), F.count_if("is_wrong_count").alias("n_wrong"), F.count_if("is_empty").alias("n_empty")
        ),
        "mean_count",
    )


@query(
    f"""WITH {COUNTS} SELECT video_idx, frame_idx, n AS n_instances, n < expected_count AS is_incomplete, n > expected_count AS is_overcount
    FROM counts JOIN expected USING (video_idx) WHERE NOT is_negative AND n <> expected_count"""
)
def wrong_count_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.count_check(frame_checks.frame_table(derived(spark, sf_dir)))
    return got.where("is_wrong_count").select(*FRAME, "n_instances", "is_incomplete", "is_overcount")


SEEN = " + ".join(f"(CASE WHEN x{k} IS NOT NULL THEN 1 ELSE 0 END)" for k in range(N))
C_SUM = " + ".join(f"coalesce(c{k}, 0.0)" for k in range(N))
C_MIN = f"least({', '.join(f'c{k}' for k in range(N))})"
C_NODE = "CASE " + " ".join(f"WHEN c{k} = {C_MIN} THEN {k}" for k in range(N)) + " END"
FACTS = f"frames AS {FRAMES_SQL}, inst AS (SELECT *, {SEEN} AS n_visible, {C_MIN} AS min_score, {C_NODE} AS min_node, ({C_SUM}) / nullif({SEEN}, 0) AS avg_score FROM {INSTANCES_SQL} t)"


@query(
    f"""WITH {FACTS}, cutoff AS (SELECT greatest(1.0, floor(avg(n_visible) * 0.5 + 0.5)) AS c FROM inst)
    SELECT video_idx, frame_idx, min(n_visible) AS min_visible, arg_min(inst_idx, n_visible * 1000 + inst_idx) AS sparsest
    FROM frames JOIN inst USING (video_idx, frame_idx) CROSS JOIN cutoff WHERE NOT is_negative GROUP BY video_idx, frame_idx, c HAVING min(n_visible) < c"""
)
def sparse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = derived(spark, sf_dir)
    got = frame_checks.frame_table(project).crossJoin(frame_checks.sparse_cutoff(project, 0.5))
    return got.where("not is_negative and min_visible < sparse_cutoff").select(*FRAME, "min_visible", "sparsest")


@query(
    f"""WITH {FACTS} SELECT video_idx, frame_idx, round(min(avg_score), 4) AS avg_score, arg_min(inst_idx, struct_pack(a := avg_score, b := inst_idx)) AS avg_instance,
    round(min(min_score), 4) AS min_score, arg_min(min_node, struct_pack(a := min_score, b := inst_idx)) AS low_node
    FROM frames JOIN inst USING (video_idx, frame_idx) WHERE avg_score IS NOT NULL GROUP BY video_idx, frame_idx HAVING min(avg_score) < 0.3"""
)
def confidence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.frame_table(derived(spark, sf_dir)).where("avg_score < 0.3")
    return rounded(got.select(*FRAME, "avg_score", "avg_instance", "min_score", "low_node"), "avg_score", "min_score")


@query(
    f"""WITH {FACTS} SELECT video_idx, frame_idx, min(inst_score) AS inst_score, arg_min(inst_idx, struct_pack(a := inst_score, b := inst_idx)) AS inst_instance
    FROM frames JOIN inst USING (video_idx, frame_idx) WHERE inst_score IS NOT NULL GROUP BY video_idx, frame_idx HAVING min(inst_score) < 0.3"""
)
def inst_confidence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_checks.frame_table(derived(spark, sf_dir)).where("inst_score < 0.3").select(*FRAME, "inst_score", "inst_instance")


@query(f"WITH {COUNTS} SELECT video_idx, frame_idx, n AS n_instances FROM counts WHERE is_negative AND n > 0")
def negative_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_checks.frame_table(derived(spark, sf_dir)).where("is_negative and n_instances > 0").select(*FRAME, "n_instances")


def _box(p: str) -> str:
    return f"({p}.hi_x - {p}.lo_x) * ({p}.hi_y - {p}.lo_y)"


_GAPS = [f"sqrt(power(a.x{k} - b.x{k}, 2) + power(a.y{k} - b.y{k}, 2))" for k in range(N)]
BOXED = ", ".join(f"{f}({', '.join(f'{a}{k}' for k in range(N))}) AS {o}_{a}" for a in "xy" for o, f in (("lo", "least"), ("hi", "greatest")))
PAIRS = f"""inst AS (SELECT *, {SEEN} AS n_visible, {BOXED} FROM {INSTANCES_SQL} t),
pairs AS (SELECT a.video_idx, a.frame_idx, a.inst_idx AS inst_a, b.inst_idx AS inst_b, a.n_visible AS na, b.n_visible AS nb,
 greatest(0.0, least(a.hi_x, b.hi_x) - greatest(a.lo_x, b.lo_x)) * greatest(0.0, least(a.hi_y, b.hi_y) - greatest(a.lo_y, b.lo_y)) AS inter, {_box('a')} + {_box('b')} AS areas,
 {' + '.join(f'CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END' for x in _GAPS)} AS common, {' + '.join(f'CASE WHEN {x} < 10 THEN 1 ELSE 0 END' for x in _GAPS)} AS near
 FROM inst a JOIN inst b ON a.video_idx = b.video_idx AND a.frame_idx = b.frame_idx AND a.inst_idx < b.inst_idx),
judged AS (SELECT *, CASE WHEN na >= 2 AND nb >= 2 AND areas - inter > 0 THEN inter / (areas - inter) ELSE 0.0 END AS iou FROM pairs),
doubles AS (SELECT video_idx, frame_idx, inst_a, inst_b, iou, CASE WHEN iou > 0.5 THEN 'iou' WHEN common >= 2 AND near > 0.8 * common THEN 'node_overlap' END AS reason FROM judged)"""


@query(f"WITH {PAIRS} SELECT video_idx, frame_idx, inst_a, inst_b, round(iou, 4) AS iou, reason FROM doubles WHERE reason IS NOT NULL")
def duplicates_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame_checks.duplicate_pairs(derived(spark, sf_dir)), "iou")


OUTSIDE = [f"(x{k} < 0 OR x{k} > {WIDTH} OR y{k} < 0 OR y{k} > {HEIGHT})" for k in range(N)]


@query(
    f"""SELECT video_idx, frame_idx, inst_idx, CASE {' '.join(f'WHEN {o} THEN {k}' for k, o in enumerate(OUTSIDE))} END AS first_node,
    {' + '.join(f'CASE WHEN {o} THEN 1 ELSE 0 END' for o in OUTSIDE)} AS n_nodes FROM {INSTANCES_SQL} t WHERE {' OR '.join(OUTSIDE)}"""
)
def out_of_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.out_of_frame(derived(spark, sf_dir))
    return got.select(*KEY, F.element_at("nodes", 1).alias("first_node"), F.size("nodes").alias("n_nodes"))


FRAME_FLAGS = f"""{COUNTS}, facts AS (SELECT *, {SEEN} AS n_visible, ({C_SUM}) / nullif({SEEN}, 0) AS avg_score FROM inst), cutoff AS (SELECT greatest(1.0, floor(avg(n_visible) * 0.5 + 0.5)) AS c FROM facts),
worst AS (SELECT video_idx, frame_idx, min(n_visible) AS v, min(avg_score) AS a, min(inst_score) AS s, bool_or({' OR '.join(OUTSIDE)}) AS o FROM facts GROUP BY video_idx, frame_idx)"""


@query(
    f"""WITH {FRAME_FLAGS} SELECT video_idx, frame_idx, NOT is_negative AND n <> expected_count AS is_wrong_count, coalesce(NOT is_negative AND v < c, false) AS is_sparse,
    coalesce(a < 0.3, false) AS is_low_confidence, coalesce(s < 0.3, false) AS is_low_inst_confidence, is_negative AND n > 0 AS is_negative_with_instances, coalesce(o, false) AS is_out_of_frame
    FROM counts JOIN expected USING (video_idx) LEFT JOIN worst USING (video_idx, frame_idx) CROSS JOIN cutoff"""
)
def frame_check_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.frame_checks(derived(spark, sf_dir))
    return got.select(*FRAME, "is_wrong_count", "is_sparse", "is_low_confidence", "is_low_inst_confidence", "is_negative_with_instances", "is_out_of_frame")


@query(f"SELECT 3 AS videos, (SELECT count(*) FROM orders) AS frames, (SELECT count(*) FROM lineitem) AS instances, count(*) FILTER (WHERE n = 0) AS empty_frames FROM (WITH {COUNTS} SELECT n FROM counts) t")
def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = derived(spark, sf_dir)
    got = frame_checks.frame_table(project).agg(F.count(F.lit(1)).alias("frames"), F.sum("n_instances").alias("instances"), F.count_if(F.col("n_instances") == 0).alias("empty_frames"))
    return project.videos.agg(F.count(F.lit(1)).cast("int").alias("videos")).crossJoin(got)


# ----------------------------------------------------------------- features

_NAMES = g.measure_names(CHAIN)
_MEASURED = g.layers_sql(f"{INSTANCES_SQL} t", g.measures(CHAIN))
_STATS = f"stats AS (SELECT {', '.join(g.fit_aggregates(_NAMES))} FROM measured)"
_WITH_FEATURES = f"measured AS (SELECT * FROM {_MEASURED} m), {_STATS}"
BASELINE = list(FEATURES[:12])


_BASE_SQL = g.layers_sql("(SELECT * FROM measured CROSS JOIN stats)", g.baseline_features(CHAIN, lambda n: n))


def fit_baseline(instances: DataFrame) -> dict[str, float]:
    """Statistics over all instances, one row."""
    return g.add_layers(instances, g.measures(CHAIN)).selectExpr(*g.fit_aggregates(_NAMES)).first().asDict()


@query(f"WITH {_WITH_FEATURES} SELECT video_idx, frame_idx, inst_idx, {', '.join(f'round({f}, 4) AS {f}' for f in BASELINE)} FROM {_BASE_SQL} b")
def baseline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = derived(spark, sf_dir).instances
    got = features.baseline(instances, CHAIN, fit_baseline(instances))
    return rounded(got.select(*KEY, *BASELINE), *BASELINE)


_FIT_SQL = ", ".join(f"avg({f}) AS m_{f}, greatest(stddev_pop({f}), 1e-6) AS s_{f}" for f in BASELINE)
_Z_SQL = ", ".join(f"abs(({f} - m_{f}) / s_{f})" for f in BASELINE)
SCORED_SQL = f"{_WITH_FEATURES}, base AS (SELECT * FROM {_BASE_SQL} b), zfit AS (SELECT {_FIT_SQL} FROM base), scored AS (SELECT base.*, 1.0 / (1.0 + exp(-(greatest({_Z_SQL}) - 3.0))) AS anomaly, {', '.join(f'abs(({f} - zfit.m_{f}) / zfit.s_{f}) AS zz_{f}' for f in BASELINE)} FROM base CROSS JOIN zfit)"


def baseline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all instances, held: filters on features would otherwise be
    pushed down and written out over every layer of the geometry."""
    instances = derived(spark, sf_dir).instances
    return features.baseline(instances, CHAIN, fit_baseline(instances)).select(*KEY, *BASELINE).persist()


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Baseline features with the anomaly score fitted on all of them."""
    table_ = baseline_table(spark, sf_dir)
    fitted = zscore.fit_zscore(table_, BASELINE)
    return zscore.anomaly_score(table_, fitted).persist(), fitted


@query(f"WITH {SCORED_SQL} SELECT video_idx, frame_idx, inst_idx, round(anomaly, 4) AS anomaly, anomaly >= 0.7 AS flagged FROM scored")
def zscore_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = scored(spark, sf_dir)
    return rows.select(*KEY, F.round("anomaly", 4).alias("anomaly"), (F.col("anomaly") >= 0.7).alias("flagged"))


@query(f"WITH {SCORED_SQL} SELECT video_idx, frame_idx, inst_idx, round(zz_max_edge_zscore, 4) AS z FROM scored WHERE zz_max_edge_zscore >= 3")
def feature_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fitted = scored(spark, sf_dir)
    return zscore.feature_check(rows, fitted, "max_edge_zscore", 3.0).select(*KEY, F.round("z", 4).alias("z"))


@query(f"WITH {SCORED_SQL} SELECT video_idx, frame_idx, round(max(anomaly), 4) AS anomaly, arg_max(inst_idx, struct_pack(a := anomaly, b := -inst_idx)) AS anomaly_inst FROM scored GROUP BY video_idx, frame_idx")
def frame_rollup_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = scored(spark, sf_dir)
    return rounded(flags.rollup_max(rows, ["anomaly"]), "anomaly")


@query(
    f"""WITH measured AS (SELECT * FROM {_MEASURED} m), vis AS (SELECT {', '.join(g.co_visibility(CHAIN))} FROM measured)
    SELECT video_idx, frame_idx, inst_idx, round({g.visibility_pattern(CHAIN, lambda n: n)['visibility_pattern_score']}, 4) AS visibility_pattern_score FROM measured CROSS JOIN vis"""
)
def visibility_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.add_layers(derived(spark, sf_dir).instances, g.measures(CHAIN))
    p = rows.selectExpr(*g.co_visibility(CHAIN)).first().asDict()
    got = g.add_layers(rows, [g.visibility_pattern(CHAIN, features.literal(p))])
    return rounded(got.select(*KEY, "visibility_pattern_score"), "visibility_pattern_score")


_CURVED = g.layers_sql(_MEASURED, g.curvature(CHAIN.spine))
CURVATURE = ["max_curvature", "mean_curvature", "curvature_std"]


@query(f"SELECT video_idx, frame_idx, inst_idx, {', '.join(f'round({c}, 4) AS {c}' for c in CURVATURE)} FROM {_CURVED} c")
def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.add_layers(derived(spark, sf_dir).instances, [*g.measures(CHAIN), *g.curvature(CHAIN.curvature_chains()[0])])
    return rounded(rows.select(*KEY, *CURVATURE), *CURVATURE)


_ORDERED = g.layers_sql(_MEASURED, g.ordering(CHAIN.ordered_chains()))


@query(f"SELECT video_idx, frame_idx, inst_idx, round(order_inversion_rate, 4) AS order_inversion_rate, CAST(chain_intersection_count AS INTEGER) AS chain_intersection_count, round(ordering_score, 4) AS ordering_score FROM {_ORDERED} o")
def chain_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.add_layers(derived(spark, sf_dir).instances, [*g.measures(CHAIN), *g.ordering(CHAIN.ordered_chains())])
    got = rows.select(*KEY, "order_inversion_rate", F.col("chain_intersection_count").cast("int").alias("chain_intersection_count"), "ordering_score")
    return rounded(got, "order_inversion_rate", "ordering_score")


@query()
def hull_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.hull_columns(derived(spark, sf_dir).instances, N)
    return rounded(got.select(*KEY, "hull_area", "hull_compactness"), "hull_area", "hull_compactness")


@query()
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = derived(spark, sf_dir)
    return rounded(features.feature_table(project, features.fit_features(project)), *FEATURES)


@query()
def gmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run(derived(spark, sf_dir), QCConfig(checks={"gmm": True, "anomaly": True}))
    return run.instance_scores.select(*KEY, F.round("gmm", 6).alias("gmm"), "gmm_feature", F.round("anomaly", 6).alias("anomaly"))


@query()
def chirality(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = derived(spark, sf_dir).instances
    return structure.chirality_scores(instances, structure.fit_chirality(instances, CHAIN), N).select(*KEY, F.round("chirality", 6).alias("chirality"), "chirality_node")


@query()
def pose_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = derived(spark, sf_dir).instances
    got = structure.split_scores(instances, CHAIN, fit_baseline(instances))
    return got.select(*KEY, F.round("pose_split", 6).alias("pose_split"), "bridge_a", "bridge_b")


@query()
def quality_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default checks in one run: flags of each frame and their union."""
    got = Run(held(derived(spark, sf_dir))).frames
    return got.select(*FRAME, *[c for c in got.columns if c.startswith("flag_")], "frame_flagged")


# -------------------------------------------------------- flags and rankings

LIMITS_SQL = f"""{SCORED_SQL}, flags AS (SELECT video_idx, frame_idx, inst_idx, anomaly >= 0.7 AS flag_anomaly, zz_max_edge_zscore >= 3 AS flag_edge, zz_max_angle_zscore >= 3 AS flag_angle,
zz_bbox_area_zscore >= 3 AS flag_bbox FROM scored)"""
FLAGS = ["flag_anomaly", "flag_edge", "flag_angle", "flag_bbox"]


def instance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fitted = scored(spark, sf_dir)
    z = zscore.add_zscores(rows, {f: fitted[f] for f in ("max_edge_zscore", "max_angle_zscore", "bbox_area_zscore")})
    return z.select(*KEY, (F.col("anomaly") >= 0.7).alias("flag_anomaly"), *[(F.col(f"z_{f}") >= 3).alias(n) for f, n in (("max_edge_zscore", "flag_edge"), ("max_angle_zscore", "flag_angle"), ("bbox_area_zscore", "flag_bbox"))])


@query(f"WITH {LIMITS_SQL} SELECT DISTINCT video_idx, frame_idx FROM flags WHERE {' OR '.join(FLAGS)}")
def flag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instance_flags(spark, sf_dir).where(flags.any_of(FLAGS)).select(*FRAME).distinct()


@query(
    f"WITH {LIMITS_SQL} "
    + " UNION ALL ".join(f"SELECT '{a}' AS detector_a, '{b}' AS detector_b, count(*) FILTER (WHERE {a} AND {b}) AS n FROM flags" for i, a in enumerate(FLAGS) for b in FLAGS[i:])
)
def detector_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.overlap_sizes(instance_flags(spark, sf_dir), FLAGS)


@query(f"WITH {LIMITS_SQL} SELECT {', '.join(FLAGS)}, count(*) AS n FROM flags WHERE {' OR '.join(FLAGS)} GROUP BY ALL ORDER BY n DESC, {', '.join(f + ' DESC' for f in FLAGS)} LIMIT 12")
def upset_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.exact_combinations(instance_flags(spark, sf_dir), FLAGS)


@query(f"WITH {LIMITS_SQL} SELECT video_idx, frame_idx, inst_idx, CASE WHEN flag_edge THEN 'feature' WHEN flag_anomaly THEN 'anomaly' END AS reason FROM flags WHERE flag_edge OR flag_anomaly")
def blame_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explain.first_reason(instance_flags(spark, sf_dir), {"anomaly": "flag_anomaly", "feature": "flag_edge"}, "reason")
    return rows.where("reason is not null").select(*KEY, "reason")


_SIGNALS = {"anomaly": ("anomaly", 2.2), "angle": ("zz_max_angle_zscore", 4.5), "mean_angle": ("zz_mean_angle_zscore", 3.5)}
_QUEUE_SQL = f"""{SCORED_SQL}, sig AS (SELECT video_idx, frame_idx, inst_idx, round(anomaly, 9) AS anomaly, round(zz_max_angle_zscore, 9) AS angle, round(zz_mean_angle_zscore, 9) AS mean_angle FROM scored),
pct AS (SELECT *, {', '.join(f'percent_rank() OVER (ORDER BY {s}) AS pct_{s}' for s in _SIGNALS)} FROM sig)"""


def _queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fitted = scored(spark, sf_dir)
    z = lambda f: F.abs((F.col(f) - fitted[f][0]) / fitted[f][1])
    return rows.select(*KEY, F.round("anomaly", 9).alias("anomaly"), F.round(z("max_angle_zscore"), 9).alias("angle"), F.round(z("mean_angle_zscore"), 9).alias("mean_angle"))


@query(
    f"""WITH {_QUEUE_SQL} SELECT video_idx, frame_idx, inst_idx, round({' + '.join(f"{-2.0 * w} * ln(greatest(1e-4, 1.0 - pct_{s}))" for s, (_, w) in _SIGNALS.items())}, 3) AS evidence,
    CAST({' + '.join(f'CASE WHEN pct_{s} >= 0.95 THEN 1 ELSE 0 END' for s in _SIGNALS)} AS INTEGER) AS agree, pct_angle >= 0.95 AS priority FROM pct"""
)
def percentile_fisher_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = flags.proofreading_queue(_queue_rows(spark, sf_dir), KEY, list(_SIGNALS))
    return rounded(got.select(*KEY, "evidence", "agree", "priority"), "evidence", digits=3)


@query(
    f"""WITH {_QUEUE_SQL}, q AS (SELECT {' + '.join(f'CASE WHEN pct_{s} >= 0.95 THEN 1 ELSE 0 END' for s in _SIGNALS)} AS agree, * FROM pct)
    SELECT 'agree' AS kind, CAST(agree AS VARCHAR) AS name, count(*) AS n FROM q GROUP BY agree UNION ALL """
    + " UNION ALL ".join(f"SELECT 'hot', '{s}', count(*) FILTER (WHERE pct_{s} >= 0.95) FROM q" for s in _SIGNALS)
)
def queue_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.queue_shape(flags.proofreading_queue(_queue_rows(spark, sf_dir), KEY, list(_SIGNALS)), list(_SIGNALS))


@query(
    f"""WITH {FRAME_FLAGS} SELECT video_idx, frame_idx, CAST(greatest(CASE WHEN NOT is_negative AND n <> expected_count THEN 0.9 END, CASE WHEN NOT is_negative AND v < c THEN 0.85 END, CASE WHEN o THEN 0.7 END, CASE WHEN is_negative AND n > 0 THEN 0.45 END) AS DOUBLE) AS severity,
    CAST(coalesce(CAST(NOT is_negative AND n <> expected_count AS INTEGER), 0) + coalesce(CAST(NOT is_negative AND v < c AS INTEGER), 0) + coalesce(CAST(o AS INTEGER), 0) + CAST(is_negative AND n > 0 AS INTEGER) AS INTEGER) AS n_detectors
    FROM counts JOIN expected USING (video_idx) LEFT JOIN worst USING (video_idx, frame_idx) CROSS JOIN cutoff
    WHERE coalesce(NOT is_negative AND n <> expected_count, false) OR coalesce(NOT is_negative AND v < c, false) OR coalesce(o, false) OR (is_negative AND n > 0)"""
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.frame_checks(derived(spark, sf_dir))
    names = {"count": "is_wrong_count", "sparse": "is_sparse", "outOfFrame": "is_out_of_frame", "negative": "is_negative_with_instances"}
    return flags.review_queue(got.withColumns({f"flag_{k}": F.col(c) for k, c in names.items()}), {}, list(names)).select(*FRAME, "severity", "n_detectors")


@query(
    f"""WITH {COUNTS}, f AS (SELECT video_idx, frame_idx, NOT is_negative AND n <> expected_count AS w FROM counts JOIN expected USING (video_idx))
    SELECT video_idx, frame_idx, coalesce(min(CASE WHEN w THEN frame_idx END) OVER (PARTITION BY video_idx ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
    min(CASE WHEN w THEN frame_idx END) OVER (PARTITION BY video_idx)) AS next_flagged FROM f"""
)
def next_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.count_check(frame_checks.frame_table(derived(spark, sf_dir)))
    return flags.next_flagged(got, "is_wrong_count", "video_idx", "frame_idx").select(*FRAME, "next_flagged")


_LISTED = f"""{COUNTS}, f AS (SELECT video_idx, frame_idx, NOT is_negative AND n <> expected_count AS w FROM counts JOIN expected USING (video_idx))"""


@query(
    f"""WITH {_LISTED} SELECT video_idx, frame_idx, coalesce(max(CASE WHEN w THEN frame_idx END) OVER (PARTITION BY video_idx ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    max(CASE WHEN w THEN frame_idx END) OVER (PARTITION BY video_idx)) AS previous_flagged FROM f"""
)
def previous_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.count_check(frame_checks.frame_table(derived(spark, sf_dir)))
    return flags.previous_flagged(got, "is_wrong_count", "video_idx", "frame_idx").select(*FRAME, "previous_flagged")


@query(
    f"""WITH {_LISTED} SELECT video_idx, frame_idx, coalesce(lag(frame_idx) OVER o, max(frame_idx) OVER (PARTITION BY video_idx)) AS before,
    coalesce(lead(frame_idx) OVER o, min(frame_idx) OVER (PARTITION BY video_idx)) AS after FROM f WHERE w WINDOW o AS (PARTITION BY video_idx ORDER BY frame_idx)"""
)
def listed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.count_check(frame_checks.frame_table(derived(spark, sf_dir)))
    return flags.neighbours_in(got, F.col("is_wrong_count"), "video_idx", "frame_idx").select(*FRAME, "before", "after")


_VERTICES = list(enumerate(CHAIN.spine))[1:-1]


@query(
    f"""SELECT video_idx, frame_idx, inst_idx, CASE {' '.join(f'WHEN round(abs(k{i}), 9) = m THEN {n}' for i, n in _VERTICES)} END AS blame_vertex
    FROM (SELECT *, round(greatest({', '.join(f'abs(k{i})' for i, _ in _VERTICES)}), 9) AS m FROM {_CURVED} c) t"""
)
def worst_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.add_layers(derived(spark, sf_dir).instances, [*g.measures(CHAIN), *g.curvature(CHAIN.spine)])
    steady = rows.withColumns({f"k{i}": F.round(F.abs(f"k{i}"), 9) for i, _ in _VERTICES})
    return explain.worst_vertex(steady, CHAIN.spine).select(*KEY, "blame_vertex")


@query()
def patch_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every embedding packed to bytes and unpacked again."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    got = embeddings.unpacked(embeddings.packed(rows, "v", 4, 2, 16), dim=16)
    return got.select("vec_id", F.length("packed").alias("n_bytes"), F.round(F.aggregate("tokens", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squares"))


@query()
def appearance_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearance scores of embeddings as a check of the frames they crop."""
    project = derived(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    reference = embeddings.stratified_reference(rows, "label", "vec_id")
    scored_ = embeddings.appearance_scores(rows, reference, "vec_id", "embedding", 4)
    z = embeddings.robust_z(scored_, "score", ["label"]).withColumn("inst_idx", F.lit(0))
    crops = project.instances.where("inst_idx = 0").select(*KEY).withColumn("vec_id", F.col("frame_idx"))
    appearance = crops.join(z.select("vec_id", F.col("z").alias("appearance")), "vec_id").drop("vec_id")
    run = Run(project, QCConfig(checks={"count": True}), appearance)
    return run.frames.select(*FRAME, "flag_appearance", "frame_flagged")


@query(
    f"""WITH {COUNTS}, f AS (SELECT floor(frame_idx * 40 / 200000.0) AS b, n, NOT is_negative AND n <> expected_count AS w FROM counts JOIN expected USING (video_idx))
    SELECT CAST(b AS BIGINT) AS bucket, max(n) AS worst, bool_or(w) AS flagged FROM f GROUP BY b"""
)
def timeline_bucket_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.count_check(frame_checks.frame_table(derived(spark, sf_dir)))
    return flags.timeline(got, "frame_idx", 200000, 40, "n_instances", "is_wrong_count")


@query(f"WITH {SCORED_SQL} SELECT CAST(least(25, greatest(0, floor((zz_max_edge_zscore + 1.0) / 7.0 * 26))) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY bin")
def histogram26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fitted = scored(spark, sf_dir)
    z = zscore.add_zscores(rows.select(*KEY, "max_edge_zscore"), {"max_edge_zscore": fitted["max_edge_zscore"]})
    return flags.clamped_histogram(z, "z_max_edge_zscore", 3.5)


_SCALED = [f"({f} / {explain.SCALE.get(f, 1.0)})" if f != "min_symmetry_consistency" else f"(CASE WHEN {f} = 1.0 THEN 0.0 ELSE {f} / 5.0 END)" for f in BASELINE]
_TOP = f"greatest({', '.join(_SCALED)})"


@query(f"WITH {_WITH_FEATURES}, base AS (SELECT * FROM {_BASE_SQL} b) SELECT CASE {' '.join(f'WHEN {s} = {_TOP} THEN ' + chr(39) + f + chr(39) for f, s in zip(BASELINE, _SCALED))} END AS top_feature, count(*) AS n FROM base GROUP BY top_feature")
def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = explain.top_issue(baseline_table(spark, sf_dir), BASELINE)
    return got.groupBy("top_feature").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT video_idx, frame_idx, inst_idx, CASE WHEN v >= 2 THEN s END AS crop_side, CASE WHEN v >= 2 THEN (hi_x + lo_x) / 2 - s / 2 END AS crop_x, CASE WHEN v >= 2 THEN (hi_y + lo_y) / 2 - s / 2 END AS crop_y
    FROM (SELECT *, {SEEN} AS v, greatest(hi_x - lo_x, hi_y - lo_y) * 1.7 + 16 AS s FROM (SELECT *, {BOXED} FROM {INSTANCES_SQL} t) u) w"""
)
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.crop_box(derived(spark, sf_dir).instances, N).select(*KEY, "crop_side", "crop_x", "crop_y")


@query(
    f"""WITH b AS (SELECT *, greatest(24.0, greatest(hi_x - lo_x, hi_y - lo_y) * 0.3) AS side FROM (SELECT *, {BOXED} FROM {INSTANCES_SQL} t) u) """
    + " UNION ALL ".join(f"SELECT video_idx, frame_idx, inst_idx, side, {k} AS node, x{k} AS x, y{k} AS y FROM b WHERE x{k} IS NOT NULL" for k in range(N))
)
def node_patch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.node_patches(derived(spark, sf_dir).instances, N, keys=KEY)


@query(f"WITH {_WITH_FEATURES}, base AS (SELECT * FROM {_BASE_SQL} b) SELECT CASE {' '.join(f'WHEN abs(z_d_{a}_{b}) = greatest({chr(44).join(f"abs(z_d_{c}_{d})" for c, d in CHAIN.edges)}) THEN {a}' for a, b in CHAIN.edges)} END AS edge_start, count(*) AS n FROM base GROUP BY edge_start")
def blamed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = derived(spark, sf_dir).instances
    got = explain.worst_edge(features.baseline(instances, CHAIN, fit_baseline(instances)), CHAIN)
    return got.groupBy(F.get("blame_edge.nodes", 0).alias("edge_start")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORED_SQL} SELECT video_idx, frame_idx, arg_max(inst_idx, struct_pack(a := greatest((anomaly - 0.7) / 0.7, (zz_max_edge_zscore - 3.0) / 3.0), b := -inst_idx)) AS worst_inst, max(greatest((anomaly - 0.7) / 0.7, (zz_max_edge_zscore - 3.0) / 3.0)) >= 0 AS worst_flagged FROM scored GROUP BY video_idx, frame_idx")
def worst_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fitted = scored(spark, sf_dir)
    z = zscore.add_zscores(rows.select(*KEY, "anomaly", "max_edge_zscore"), {"max_edge_zscore": fitted["max_edge_zscore"]})
    return explain.worst_instance(z, {"anomaly": 0.7, "z_max_edge_zscore": 3.0}, FRAME).select(*FRAME, "worst_inst", "worst_flagged")


# --------------------------------------------------------------- embeddings


@query(
    """WITH m AS (SELECT lang, median(n_chars) AS m FROM documents GROUP BY lang), d AS (SELECT doc_id, lang, n_chars, m, abs(n_chars - m) AS d FROM documents JOIN m USING (lang)),
    s AS (SELECT lang, CASE WHEN median(d) = 0 THEN 1e-9 ELSE median(d) END AS mad FROM d GROUP BY lang) SELECT doc_id, lang, round((n_chars - m) / (1.4826 * mad), 4) AS z FROM d JOIN s USING (lang)"""
)
def robust_z_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = embeddings.robust_z(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", ["lang"])
    return rounded(got.select("doc_id", "lang", "z"), "z")


REFERENCE_SQL = """sized AS (SELECT *, least(n, greatest(20, CAST(floor(n * 0.2 + 0.5) AS BIGINT))) AS k FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) t),
ref AS (SELECT vec_id, embedding, label FROM sized WHERE list_contains(list_transform(range(k), lambda j: (j * n) // k), i))"""


@query(f"WITH {REFERENCE_SQL} SELECT vec_id, label FROM ref")
def stratified_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.stratified_reference(table(spark, sf_dir, "embeddings"), "label", "vec_id").select("vec_id", "label")


DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    f"""WITH {REFERENCE_SQL}, d AS (SELECT a.vec_id, greatest(0.0, 2 - 2 * {DOT}) AS d FROM embeddings a JOIN ref b ON a.vec_id <> b.vec_id),
    r AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM d) SELECT vec_id, round(avg(sqrt(d)), 4) AS knn FROM r WHERE r <= 6 GROUP BY vec_id"""
)
def knn_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    ref = embeddings.stratified_reference(rows, "label", "vec_id")
    return rounded(embeddings.knn_outlier(rows, ref, "vec_id", "embedding").select("vec_id", "knn"), "knn")


@query(
    f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, 2 - 2 * {DOT} AS d FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM d) SELECT query_id, vec_id, round(d, 4) AS distance FROM r WHERE r <= 5"""
)
def nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all rows for every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return rounded(embeddings.nearest_each(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding"), "distance")


def _mean_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT list(m ORDER BY d) AS m FROM (SELECT d, avg(v) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS d FROM embeddings WHERE {where}) t GROUP BY d) u)"


PROTOTYPE_SQL = f"""{_mean_sql('pos', 'label = 0')}, {_mean_sql('neg', 'label = 1')}, raw AS (SELECT list_transform(list_zip(pos.m, neg.m), lambda z: z[1] - z[2]) AS w FROM pos CROSS JOIN neg),
dir AS (SELECT list_transform(w, lambda z: z / sqrt(list_inner_product(w, w))) AS w FROM raw),
proto AS (SELECT vec_id, label, list_inner_product(CAST(embedding AS DOUBLE[]), w) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS prototype FROM embeddings CROSS JOIN dir)"""


def _prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    direction = embeddings.prototype(rows, F.col("label") == 0, F.col("label") == 1, "embedding")
    return embeddings.prototype_scores(rows, direction, "embedding")


@query(f"WITH {PROTOTYPE_SQL} SELECT vec_id, round(prototype, 4) AS prototype FROM proto")
def prototype_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_prototypes(spark, sf_dir).select("vec_id", "prototype"), "prototype")


def _avg_rank(v: str) -> str:
    return f"(rank() OVER (ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / (count(*) OVER () - 1)"


@query("SELECT doc_id, round(0.7 * " + _avg_rank("n_chars") + " + 0.3 * " + _avg_rank("words") + ", 6) AS blend FROM (SELECT doc_id, n_chars, length(text) - length(replace(text, ' ', '')) AS words FROM documents) t")
def rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", words.alias("words"))
    return rounded(embeddings.rank_blend(rows, "n_chars", "words", 0.3).select("doc_id", "blend"), "blend", digits=6)


@query()
def memory_bank_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    ref = embeddings.stratified_reference(rows, "label", "vec_id")
    return rounded(embeddings.patch_scores(rows, ref, "vec_id", "embedding", 8).select("vec_id", "patch"), "patch")


@query()
def pca2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embeddings.pca2(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "pc1", "pc2")


#: labelled rows of each of two groups that a classifier is fitted on, those of
#: least hash: time and memory of the fit grow with the square of the rows
SVM_GROUP_ROWS = 300


@query()
def svm_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on SVM_GROUP_ROWS labelled rows of either group, scored on all."""
    rows = table(spark, sf_dir, "embeddings")
    parts = [rows.where(F.col("label") == g).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SVM_GROUP_ROWS).toPandas() for g in (0, 1)]
    train = pd.concat(parts, ignore_index=True)
    model, _ = svm.fit_svm(np.stack(train["embedding"].to_numpy()), np.where(train["label"] == 0, 1, -1))
    return rounded(svm.svm_scores(rows.select("vec_id", "embedding"), model, "embedding").select("vec_id", "decision", "probability"), "decision", "probability")


_GROUP_MEANS_SQL = "means AS (SELECT label, list(m ORDER BY d) AS m FROM (SELECT label, d, avg(v) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS d FROM embeddings) t GROUP BY label, d) u GROUP BY label)"


@query(f"WITH {_GROUP_MEANS_SQL} SELECT a.label, b.label AS other, round(list_inner_product(a.m, b.m), 4) + 0.0 AS similarity FROM means a CROSS JOIN means b")
def group_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of all rows of each group to all rows of each group: the
    mean over pairs is the product of the groups' means."""
    sums = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "v")).groupBy("label", "d").agg(F.avg(F.col("v").cast("double")).alias("v"))
    means = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("m"))
    pairs = means.crossJoin(F.broadcast(means.select(F.col("label").alias("other"), F.col("m").alias("n"))))
    return pairs.select("label", "other", (F.round(dot(F.col("m"), F.col("n")), 4) + 0.0).alias("similarity"))


# ---------------------------------------------------------------- agreement

_CONFUSION = """count(*) FILTER (WHERE f AND t) AS tp, count(*) FILTER (WHERE f AND NOT t) AS fp, count(*) FILTER (WHERE NOT f AND t) AS fn, count(*) FILTER (WHERE NOT f AND NOT t) AS tn"""
_RATES = """round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
round((tp + tn) * 1.0 / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(((tp + tn) * 1.0 / n - pe) / nullif(1 - pe, 0), 0), 6) AS kappa"""
_JUDGED = "judged AS (SELECT lang, n_chars < 1000 AS f, quality = 0 AS t FROM documents JOIN labels USING (doc_id))"
_CHANCE = "(tp + fp + fn + tn) AS n, ((tp + fp) * 1.0 * (tp + fn) + (fn + tn) * 1.0 * (fp + tn)) / ((tp + fp + fn + tn) * 1.0 * (tp + fp + fn + tn)) AS pe"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "n_chars", (F.col("n_chars") < 1000).alias("flag"), (F.col("quality") == 0).alias("truth"))


METRICS = ("precision", "recall", "f1", "accuracy", "kappa")


@query(f"WITH {_JUDGED}, c AS (SELECT {_CONFUSION} FROM judged), p AS (SELECT *, {_CHANCE} FROM c) SELECT tp, fp, fn, tn, {_RATES} FROM p")
def confusion_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.confusion(_judged(spark, sf_dir), "flag", "truth"), *METRICS, digits=6)


@query(f"WITH {_JUDGED}, c AS (SELECT lang, {_CONFUSION} FROM judged GROUP BY lang), p AS (SELECT *, {_CHANCE} FROM c) SELECT lang, tp, fp, fn, tn, {_RATES} FROM p")
def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.confusion(_judged(spark, sf_dir), "flag", "truth", ["lang"]), *METRICS, digits=6)


@query(
    f"""WITH j AS (SELECT n_chars < 1000 AS short, n_chars > 4000 AS long, quality = 0 AS t FROM documents JOIN labels USING (doc_id)), u AS (SELECT 'short' AS detector, short AS f, t FROM j UNION ALL SELECT 'long', long, t FROM j),
    c AS (SELECT detector, {_CONFUSION} FROM u GROUP BY detector) SELECT detector, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"""
)
def detector_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).select((F.col("n_chars") < 1000).alias("short"), (F.col("n_chars") > 4000).alias("long"), "truth")
    return rounded(agreement.detector_f1(rows, ["short", "long"], "truth").select("detector", "f1"), "f1", digits=6)


@query(
    """WITH j AS (SELECT n_chars AS s, quality = 0 AS t FROM documents JOIN labels USING (doc_id)), r AS (SELECT t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM j)
    SELECT round((sum(r) FILTER (WHERE t) - count(*) FILTER (WHERE t) * (count(*) FILTER (WHERE t) + 1) / 2.0) / (count(*) FILTER (WHERE t) * count(*) FILTER (WHERE NOT t)), 6) AS roc_auc FROM r"""
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.roc_auc(_judged(spark, sf_dir), "n_chars", "truth"), "roc_auc", digits=6)


@query(
    """WITH j AS (SELECT doc_id, n_chars AS s, quality = 0 AS t FROM documents JOIN labels USING (doc_id)), r AS (SELECT t, sum(CAST(t AS INTEGER)) OVER w * 1.0 / count(*) OVER w AS p FROM j
    WINDOW w AS (ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT round(avg(p), 6) AS average_precision FROM r WHERE t"""
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.average_precision(_judged(spark, sf_dir), "n_chars", "truth", "doc_id"), "average_precision", digits=6)


# ------------------------------------------------------- sources and labels

_CSV_SQL = "csv AS (SELECT doc_id % 3 AS video, doc_id // 3 AS frame_idx, doc_id % 2 AS instance, CASE WHEN quality = 0 THEN ' nose; tail;; ' WHEN toxic = 1 THEN 'neck' ELSE '' END AS bad_keypoints, CASE WHEN quality = 0 THEN 'Faulty' ELSE 'ok' END AS status, 'n' || CAST(doc_id % 5 AS VARCHAR) AS notes FROM labels)"


def _label_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table in the form of a review file, all text."""
    rows = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    bad = F.when(F.col("quality") == 0, " nose; tail;; ").when(F.col("toxic") == 1, "neck").otherwise("")
    return rows.select(
        (d % 3).cast("string").alias("video"), F.floor(d / 3).cast("string").alias("frame_idx"), (d % 2).cast("string").alias("instance"), bad.alias("bad_keypoints"),
        F.when(F.col("quality") == 0, "Faulty").otherwise("ok").alias("status"), F.concat(F.lit("n"), (d % 5).cast("string")).alias("notes"),
    )


@query(f"WITH {_CSV_SQL} SELECT CAST(video AS INTEGER) AS video_idx, CAST(frame_idx AS INTEGER) AS frame_idx, CAST(instance AS INTEGER) AS inst_idx, array_to_string(list_filter(list_transform(string_split(bad_keypoints, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS bad FROM csv")
def keypoint_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parse_keypoint_labels(_label_csv(spark, sf_dir)).withColumn("bad", F.array_join("bad", "|"))


@query(f"WITH {_CSV_SQL} SELECT CAST(video AS INTEGER) AS video_idx, CAST(frame_idx // 4 AS INTEGER) AS frame_idx, bool_or(status = 'Faulty') AS faulty FROM csv GROUP BY video, frame_idx // 4")
def review_csv_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _label_csv(spark, sf_dir).withColumn("frame_idx", F.floor(F.col("frame_idx").cast("int") / 4).cast("string"))
    return tables.parse_review(rows)[0].select("video_idx", "frame_idx", "faulty")


@query(f"WITH {_CSV_SQL} SELECT node, count(*) AS n FROM (SELECT DISTINCT video, frame_idx, instance, unnest(list_filter(list_transform(string_split(bad_keypoints, ';'), lambda x: trim(x)), lambda x: x <> '')) AS node FROM csv) t GROUP BY node")
def label_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.tally(labels.merge_labels(tables.parse_keypoint_labels(_label_csv(spark, sf_dir))))


@query(f"WITH {_CSV_SQL}, p AS (SELECT video, frame_idx, instance, list_filter(list_transform(string_split(bad_keypoints, ';'), lambda x: trim(x)), lambda x: x <> '') AS bad FROM csv) SELECT row_number() OVER (ORDER BY video, frame_idx, instance) - 1 AS frame_index, CAST(frame_idx AS INTEGER) AS frame_idx, CAST(video AS INTEGER) AS video, CAST(instance AS INTEGER) AS instance, CAST(len(bad) AS INTEGER) AS n_bad_keypoints, array_to_string(list_sort(bad), ';') AS bad_keypoints FROM p")
def keypoint_label_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.keypoint_label_rows(labels.merge_labels(tables.parse_keypoint_labels(_label_csv(spark, sf_dir))))


@query(f"""WITH inst AS {INSTANCES_SQL} SELECT video_idx, frame_idx, inst_idx, CASE WHEN l % 5 = 0 THEN 1.5 ELSE x0 END AS x0, CASE WHEN l % 5 = 0 THEN 2.5 ELSE y0 END AS y0, CASE WHEN l % 5 = 1 THEN NULL ELSE x1 END AS x1
FROM (SELECT *, frame_idx + inst_idx AS l FROM inst) t""")
def edits_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = derived(spark, sf_dir).instances
    place = (F.col("frame_idx") + F.col("inst_idx")) % 5
    move = instances.where(place == 0).select(*KEY, F.lit(0).alias("node"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.lit(1.5).alias("x"), F.lit(2.5).alias("y"), F.lit(True).alias("visible"))
    hide = instances.where(place == 1).select(*KEY, F.lit(1).alias("node"), F.lit(3).alias("seq"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("visible"))
    return edits.apply_moves(instances, move.unionByName(hide), N).select(*KEY, "x0", "y0", "x1")


@query(f"SELECT video_idx, frame_idx, CAST(row_number() OVER (PARTITION BY video_idx, frame_idx ORDER BY inst_idx) - 1 AS INTEGER) AS inst_idx, x0 FROM {INSTANCES_SQL} t WHERE (frame_idx + inst_idx) % 4 <> 0")
def edits_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = derived(spark, sf_dir).instances
    return edits.delete_instances(instances, instances.where("(frame_idx + inst_idx) % 4 = 0")).select(*KEY, "x0")


@query()
def results_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run(derived(spark, sf_dir))
    return exports.as_text(exports.qc_results(run.instance_scores, run.frames))


@query()
def incremental_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the instances moved and scored against the frozen fit."""
    run = Run(derived(spark, sf_dir), QCConfig(checks={"anomaly": True}))
    moved = run.project.instances.where("frame_idx % 5 = 0").withColumn("x0", F.col("x0") + 40)
    changes = rescore.rescore(moved, run.project, run.fitted, run.zscore_fit, run.config)
    return rounded(rescore.frame_scores(rescore.upsert(run.instance_scores.select(*KEY, "anomaly"), changes)), "anomaly")


@query(
    """SELECT user_id, CAST(floor(value / 10.0 + 0.5) AS BIGINT) AS level, count(*) AS n FROM events GROUP BY user_id, level"""
)
def half_up_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id", round_half_up(F.col("value") / 10.0).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT event_type, user_id, value, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, user_id, round(value, 6) AS value, round(CASE WHEN n > 1 THEN (rank() OVER (PARTITION BY event_type ORDER BY value) - 1 + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0) / (n - 1) ELSE 0.5 END, 6) AS rank FROM w"""
)
def rank_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings.rank_in_group(table(spark, sf_dir, "events"), "value", "event_type")
    return rows.select("event_type", "user_id", F.round("value", 6).alias("value"), F.round("rank", 6).alias("rank"))



# ------------------------------------------------------------------ reports


@query(f"SELECT video_idx, frame_idx, inst_idx, count(*) OVER (PARTITION BY video_idx, frame_idx) AS n_siblings FROM {INSTANCES_SQL} t")
def frame_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.siblings(derived(spark, sf_dir).instances).select(*KEY, "n_siblings")


_ALONE = " UNION ALL ".join(
    f"SELECT '{a}' AS detector, greatest(0, count(*) FILTER (WHERE {a}) - {' - '.join(f'count(*) FILTER (WHERE {a} AND {b})' for b in FLAGS if b != a)}) AS alone FROM flags" for a in FLAGS
)


@query(f"WITH {LIMITS_SQL} {_ALONE}")
def chord_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chord_remainders(flags.overlap_sizes(instance_flags(spark, sf_dir), FLAGS))


@query(
    f"""WITH {FRAME_FLAGS} SELECT video_idx, frame_idx, concat_ws(',', CASE WHEN NOT is_negative AND n <> expected_count THEN CASE WHEN n = 0 THEN 'Empty frame' WHEN n > expected_count THEN 'Extra instance' ELSE 'Missing instance' END END,
    CASE WHEN NOT is_negative AND v < c THEN 'Sparse instance' END, CASE WHEN is_negative AND n > 0 THEN 'Negative' END, CASE WHEN o THEN 'Out of frame' END) AS labels
    FROM counts JOIN expected USING (video_idx) LEFT JOIN worst USING (video_idx, frame_idx) CROSS JOIN cutoff"""
)
def flagging_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame_checks.frame_checks(derived(spark, sf_dir))
    listed = reports.flagging_checks(got, {"count": "is_wrong_count", "sparse": "is_sparse", "negative": "is_negative_with_instances", "outOfFrame": "is_out_of_frame"})
    return listed.select(*FRAME, F.array_join(F.transform("checks", lambda c: c["label"]), ",").alias("labels"))


@query(
    f"""WITH n AS ({' UNION ALL '.join(f"SELECT video_idx, frame_idx, inst_idx, '{CHAIN.names[k]}' AS node, c{k} AS z FROM {INSTANCES_SQL} t WHERE c{k} IS NOT NULL" for k in range(N))}),
    w AS (SELECT video_idx, frame_idx, inst_idx, max(z) AS z FROM n GROUP BY ALL) SELECT video_idx, frame_idx, max(z) AS z, count(*) AS n_instances FROM w GROUP BY ALL"""
)
def node_rollup_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = F.array(*[F.struct(F.lit(CHAIN.names[k]).alias("node"), F.col(f"c{k}").alias("z")) for k in range(N)])
    long = derived(spark, sf_dir).instances.select(*KEY, F.inline(nodes)).where("z is not null")
    return reports.node_rollup(long)[1].groupBy(*FRAME).agg(F.max("z").alias("z"), F.count(F.lit(1)).alias("n_instances"))


@query()
def gmm_removal_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run(derived(spark, sf_dir), QCConfig(checks={"gmm": True}))
    return reports.removal_blame(run.instance_scores.where("gmm >= 0.99").select(*KEY), run.project, run.fitted, run.mixture_fit)


@query()
def instance_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run(derived(spark, sf_dir))
    rows = explain.top_issue(run.instance_scores, FEATURES)
    return reports.instance_verdict(rows, run.limits).where("verdict is not null").select(*KEY, "verdict", "verdict_confidence")
