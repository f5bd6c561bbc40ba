"""What reviewers read: verdicts, flagging checks, heat, focus, roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posekeel.config import FEATURES, SEVERITY
from posekeel.functions.columns import clean
from posekeel.operators import embeddings
from posekeel.operators.explain import DIRECTED, ISSUES, confidence_word, with_direction
from posekeel.operators.flags import rollup_max
from posekeel.operators.features import Fitted, feature_table
from posekeel.operators.mixture import Outliers
from posekeel.plans.pose_view import FRAME, KEY, Project

#: fixed values: order and wording of the checks that flag a frame
CHECK_LABELS = {
    "chirality": "L/R flip", "ordering": "Out of order", "poseSplit": "Split pose", "anomaly": "Anomaly", "gmm": "GMM", "count": "Wrong count",
    "sparse": "Sparse instance", "confidence": "Low conf", "instConfidence": "Low instance conf", "negative": "Negative", "outOfFrame": "Out of frame",
    "duplicates": "Duplicate",
}
#: fixed values: what part of a pose a feature is about
SHAPES = {
    "max_edge_zscore": "edge", "max_angle_zscore": "angle", "max_curvature": "angle", "curvature_std": "angle", "max_pairwise_zscore": "pair",
    "max_centroid_distance": "node", "visibility_pattern_score": "node", "has_isolated_invisible": "node", "min_symmetry_consistency": "pair",
    "bbox_area_zscore": "instance", "hull_area_zscore": "instance", "hull_compactness": "instance", "nn_distance": "instance", "visibility_rate": "instance",
}


def count_label(n: Column, expected: Column) -> Column:
    return F.when(n == 0, "Empty frame").when(n > expected, "Extra instance").otherwise("Missing instance")


def flagging_checks(frames: DataFrame, flags: Mapping[str, str], scores: Mapping[str, str] = {}) -> DataFrame:
    """Adds checks: (key, label, score) of every check that flags the frame, in
    display order; checks without a score have null."""
    parts = []
    for key, label in CHECK_LABELS.items():
        if key in flags:
            text = count_label(F.col("n_instances"), F.col("expected_count")) if key == "count" and "expected_count" in frames.columns else F.lit(label)
            score = F.col(scores[key]).cast("double") if key in scores else F.lit(None).cast("double")
            parts.append(F.when(F.col(flags[key]), F.struct(F.lit(key).alias("key"), text.alias("label"), score.alias("score"))))
    return frames.withColumn("checks", F.filter(F.array(*parts), lambda x: x.isNotNull()))


def frame_issue(frames: DataFrame) -> DataFrame:
    """Adds issue: the instance verdict if the frame has one (column verdict),
    else the most severe check without a score, else the first that flags."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    plain = F.filter("checks", lambda x: x["score"].isNull())
    ranked = F.transform(plain, lambda x, i: F.struct(F.coalesce(rank[x["key"]], F.lit(0.0)).alias("s"), (-i).alias("i"), x["label"].alias("label")))
    fallback = F.coalesce(F.array_max(ranked)["label"], F.get("checks", 0)["label"])
    return frames.withColumn("issue", F.coalesce("verdict", fallback) if "verdict" in frames.columns else fallback)


def instance_verdict(rows: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Adds verdict and verdict_confidence of flagged instances, in the order
    flip, split, ordering, anomaly, mixture; null if none is flagged.  Uses the
    columns top_feature, top_issue, direction and gmm_feature where they exist."""
    def over(score: str) -> Column:
        return F.coalesce(F.col(score) >= limits[score], F.lit(False)) if score in limits and score in rows.columns else F.lit(False)

    has = set(rows.columns)
    issue = F.col("top_issue") if "top_issue" in has else F.lit("Unknown")
    if {"top_feature", "direction"} <= has:
        issue = F.when(F.col("top_feature").isin(*DIRECTED), with_direction(issue, F.col("direction"))).otherwise(issue)
    names = F.create_map(*[F.lit(x) for kv in ISSUES.items() for x in kv])
    feature = F.coalesce(names[F.col("gmm_feature")], F.concat(F.lit("High "), F.col("gmm_feature"))) if "gmm_feature" in has else F.lit(None).cast("string")
    crossed = F.col("chain_intersection_count") >= 1 if "chain_intersection_count" in has else F.lit(False)
    order = [
        ("chirality", F.lit("Whole-instance L/R flip")),
        ("pose_split", F.lit("Split pose / chimera")),
        ("ordering_score", F.when(crossed, "Out-of-order keypoints (chain crosses)").otherwise("Out-of-order keypoints")),
        ("anomaly", issue),
        ("gmm", F.coalesce(F.concat(F.lit("Improbable pose · "), feature), F.lit("Improbable pose"))),
    ]
    verdict = F.coalesce(*[F.when(over(s), text) for s, text in order])
    score = F.coalesce(*[F.when(over(s), F.col(s)) for s, _ in order if s in limits and s in has])
    return rows.withColumns({"verdict": verdict, "verdict_confidence": F.when(verdict.isNotNull(), confidence_word(score))})


def frame_heat(frames: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Adds heat: the largest score that is over its limit, else null."""
    parts = [F.when(F.col(s) >= t, F.col(s)) for s, t in limits.items()]
    return frames.withColumn("heat", F.greatest(*parts) if len(parts) > 1 else parts[0])


def blamed_instances(instances: DataFrame, scores: Sequence[str]) -> DataFrame:
    """(frame, check, inst_idx): the instance with the largest score of each."""
    wide = rollup_max(instances, scores)
    return wide.select(*FRAME, F.inline(F.array(*[F.struct(F.lit(s).alias("check"), F.col(f"{s}_inst").alias("inst_idx")) for s in scores]))).where("inst_idx is not null")


def focus_boxes(blamed: DataFrame, instances: DataFrame, duplicates: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """Box of the blamed instance of each frame and its duplicates (of all
    instances if none is blamed), widened about its centre to ``least``."""
    both = duplicates.select(*FRAME, F.col("inst_a").alias("worst"), F.col("inst_b").alias("inst_idx")).unionByName(
        duplicates.select(*FRAME, F.col("inst_b").alias("worst"), F.col("inst_a").alias("inst_idx"))
    )
    named = blamed.where("worst is not null")
    wanted = named.select(*FRAME, F.col("worst").alias("inst_idx")).unionByName(named.join(both, [*FRAME, "worst"]).select(*FRAME, "inst_idx"))
    everyone = blamed.where("worst is null").join(instances, list(FRAME)).select(*FRAME, "inst_idx")
    xs, ys = [F.col(f"x{k}") for k in range(n)], [F.col(f"y{k}") for k in range(n)]
    box = instances.join(wanted.unionByName(everyone).distinct(), list(KEY)).groupBy(*FRAME).agg(
        F.min(F.least(*xs)).alias("x"), F.max(F.greatest(*xs)).alias("x1"), F.min(F.least(*ys)).alias("y"), F.max(F.greatest(*ys)).alias("y1")
    ).where("x is not null")
    side = {a: F.greatest(F.lit(least), F.col(f"{a}1") - F.col(a)) for a in "xy"}
    return box.select(*FRAME, *[((F.col(a) + F.col(f"{a}1") - side[a]) / 2).alias(a) for a in "xy"], side["x"].alias("w"), side["y"].alias("h"))


def node_rollup(nodes: DataFrame, score: str = "z", node: str = "node") -> tuple[DataFrame, DataFrame]:
    """Per frame the largest score; per instance its worst node and score."""
    worst = nodes.groupBy(*KEY).agg(F.max(F.struct(F.col(score).alias("z"), F.col(node).alias("n"))).alias("w")).select(*KEY, F.col("w.n").alias(node), F.col("w.z").alias(score))
    return worst.groupBy(*FRAME).agg(F.max(score).alias(score)), worst


def slot_rollup(slots: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Over the keypoint models of an instance: the highest probability, the
    node that has it, and whether it reaches the shared threshold."""
    best = slots.groupBy(*KEY).agg(F.max("probability").alias("probability"), F.max_by("node", "probability").alias("node"))
    return best.withColumn("flagged", F.col("probability") >= threshold)


def group_scores(nodes: DataFrame, value: str = "knn", least: int = 8) -> DataFrame:
    """Robust z within each node's own kind; kinds under ``least`` rows get 0."""
    return embeddings.robust_z(nodes, value, ["node"], least)


def trained_override(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Scores of nodes with a fitted model are replaced by the robust z of its
    decisions, so one threshold fits all; scorer says which it is."""
    fitted = embeddings.robust_z(decisions, "decision", ["node"]).select(*KEY, "node", F.col("z").alias("_z"))
    joined = nodes.join(fitted, [*KEY, "node"], "left")
    return joined.withColumns({"scorer": F.when(F.col("_z").isNotNull(), "svm").otherwise(F.col("scorer")), "z": F.coalesce("_z", "z")}).drop("_z")


def majority_scorer(groups: DataFrame) -> DataFrame:
    """The scorer of most groups; of equals the one seen first (column place)."""
    tally = groups.groupBy("scorer").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    return tally.agg(F.max_by("scorer", F.struct("n", -F.col("first"))).alias("scorer"))


def coverage(nodes: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Patches, patches with tokens, and wanted nodes that none covers."""
    got = nodes.agg(F.count(F.lit(1)).alias("patches"), F.count_if(F.size("patch") > 0).alias("with_tokens"), F.collect_set("node").alias("_c"))
    return got.select("patches", "with_tokens", F.array_sort(F.array_except(F.array(*[F.lit(x) for x in wanted]), "_c")).alias("missing"))


def chord_remainders(overlaps: DataFrame) -> DataFrame:
    """Flags of each detector that no other shares: its size less its overlaps,
    zero at least."""
    sizes = overlaps.where("detector_a = detector_b").select(F.col("detector_a").alias("detector"), F.col("n").alias("size"))
    pairs = overlaps.where("detector_a <> detector_b")
    shared = pairs.select(F.col("detector_a").alias("detector"), "n").unionByName(pairs.select(F.col("detector_b").alias("detector"), "n")).groupBy("detector").agg(F.sum("n").alias("shared"))
    return sizes.join(shared, "detector", "left").select("detector", F.greatest(F.lit(0), F.col("size") - F.coalesce("shared", F.lit(0))).alias("alone"))


def filter_frames(frames: DataFrame, mode: str) -> DataFrame:
    """The grid's modes: all, labeled (has instances), flagged, modified."""
    tests = {"all": F.lit(True), "labeled": F.col("n_instances") > 0, "flagged": F.col("frame_flagged"), "modified": F.col("modified")}
    return frames.where(tests[mode])


def siblings(instances: DataFrame) -> DataFrame:
    return instances.withColumn("n_siblings", F.count(F.lit(1)).over(Window.partitionBy(*FRAME)))


def next_unreviewed(queue: DataFrame, reviewed: DataFrame, position: str, group: str) -> DataFrame:
    """Adds next: position of the next row of the group that is not reviewed,
    round the end once."""
    open_ = queue.join(reviewed.select(*KEY).withColumn("_r", F.lit(True)), list(KEY), "left")
    at = F.when(F.col("_r").isNull(), F.col(position))
    later = F.min(at).over(Window.partitionBy(group).orderBy(position).rowsBetween(1, Window.unboundedFollowing))
    return open_.withColumn("next", F.coalesce(later, F.min(at).over(Window.partitionBy(group)))).drop("_r")


def queue_percentile(place: Column, n: Column) -> Column:
    """1 for the first row of a queue, 0 for the last."""
    return 1 - place / F.greatest(n - 1, F.lit(1))


def missing_signals(wanted: Sequence[str], have: Sequence[str]) -> list[str]:
    return [s for s in wanted if s not in have]


def removal_blame(flagged: DataFrame, project: Project, fitted: Fitted, model: Outliers) -> DataFrame:
    """(key, node): the visible node without which the mixture finds the pose
    most likely, if that gains more than 1e-6; else -1.  The distance to the
    nearest pose is held.  Only flagged rows are expanded, one row for each node."""
    n = project.skeleton.n_nodes
    poses = project.instances.join(flagged.select(*KEY), list(KEY))
    base = feature_table(Project(project.videos, project.frames, poses, project.skeleton), fitted, leave_one_out=False).select(*KEY, F.col("nn_distance").alias("_nn"))
    spread = poses.select(*poses.columns, F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("_k"))
    seen = F.array(*[F.col(f"x{k}").isNotNull() for k in range(n)])
    spread = spread.where((F.col("_k") < 0) | F.get(seen, F.col("_k")))
    masked = spread.withColumns({f"{a}{k}": F.when(F.col("_k") != k, F.col(f"{a}{k}")) for k in range(n) for a in "xy"})
    # the variant is carried in the instance number while features are made
    coded = masked.withColumn("inst_idx", F.col("inst_idx") * (n + 1) + F.col("_k") + 1).drop("_k")
    table = feature_table(Project(project.videos, project.frames, coded, project.skeleton), fitted, leave_one_out=False)
    place = F.col("inst_idx") % (n + 1) - 1
    back = table.withColumns({"node": place, "inst_idx": F.floor(F.col("inst_idx") / (n + 1)).cast("int")}).join(base, list(KEY)).withColumn("nn_distance", F.col("_nn"))
    shared = flagged.sparkSession.sparkContext.broadcast(model)

    def likelihood(frames):
        m = shared.value
        for frame in frames:
            x = frame[list(FEATURES)].to_numpy(float)
            yield pd.DataFrame({**{k: frame[k] for k in KEY}, "node": frame["node"], "ll": m.mixture.log_likelihood((x - m.mean) / m.scale)})

    kinds = dict(back.dtypes)
    scored = back.select(*KEY, F.col("node").cast("int").alias("node"), *[clean(F.col(f)).alias(f) for f in FEATURES]).mapInPandas(
        likelihood, ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", node int, ll double"
    )
    best = scored.groupBy(*KEY).agg(
        F.max(F.when(F.col("node") >= 0, F.struct(F.col("ll").alias("v"), (-F.col("node")).alias("k")))).alias("b"), F.max(F.when(F.col("node") < 0, F.col("ll"))).alias("whole")
    )
    return best.select(*KEY, F.when(F.col("b.v") - F.col("whole") > 1e-6, -F.col("b.k")).otherwise(F.lit(-1)).alias("node"))

