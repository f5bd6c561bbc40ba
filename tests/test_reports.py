"""What reviewers read."""

import pytest
from pyspark.sql import functions as F

from posekeel.config import QCConfig
from posekeel.operators import flags
from posekeel.operators import reports as r
from posekeel.plans.engine import Run
from posekeel.plans.pose_view import KEY, derived

KEYED = "video_idx int, frame_idx int, inst_idx int"


def test_checks_and_issue(spark):
    rows = [(0, 0, 2, True, True, 0.9), (1, 3, 2, True, False, None), (2, 2, 2, False, False, 0.8)]
    frames = spark.createDataFrame(rows, "frame_idx int, n_instances int, expected_count int, c boolean, d boolean, a double")
    got = r.frame_issue(r.flagging_checks(frames.withColumn("f", F.coalesce(F.col("a") >= 0.7, F.lit(False))), {"count": "c", "duplicates": "d", "anomaly": "f"}, {"anomaly": "a"})).orderBy("frame_idx").collect()
    assert [[c.key for c in x.checks] for x in got] == [["anomaly", "count", "duplicates"], ["count"], ["anomaly"]]
    assert [x.issue for x in got] == ["Empty frame", "Extra instance", "Anomaly"]


def test_verdict_precedence(spark):
    rows = [(0.9, 0.95, 0.9, 1.0), (0.1, 0.95, 0.9, 1.0), (0.1, 0.1, 0.9, 1.0), (0.1, 0.1, 0.2, 0.99), (0.1, 0.1, 0.2, 0.1)]
    df = spark.createDataFrame(rows, "chirality double, pose_split double, anomaly double, gmm double").withColumns(
        {"top_feature": F.lit("max_edge_zscore"), "top_issue": F.lit("Unusual edge length"), "direction": F.lit(-1), "gmm_feature": F.lit("nn_distance")}
    )
    got = r.instance_verdict(df, {"chirality": 0.5, "pose_split": 0.9, "anomaly": 0.7, "gmm": 0.95}).collect()
    assert [x.verdict for x in got] == ["Whole-instance L/R flip", "Split pose / chimera", "Unusual edge length (decreased)", "Improbable pose · Unusual pose shape", None]
    heat = r.frame_heat(df, {"anomaly": 0.7, "gmm": 0.95}).collect()
    assert [x.heat for x in heat] == [1.0, 1.0, 1.0, 0.99, None]


def test_node_rollups(spark):
    nodes = spark.createDataFrame([(0, 5, 0, "a", 1.0), (0, 5, 0, "b", 4.2), (1, 2, 0, "a", 3.0)], KEYED + ", node string, z double")
    frames, worst = r.node_rollup(nodes)
    assert {(x.video_idx, x.frame_idx): x.z for x in frames.collect()} == {(0, 5): 4.2, (1, 2): 3.0}
    assert {x.node for x in worst.where("frame_idx = 5").collect()} == {"b"}
    slots = r.slot_rollup(nodes.withColumn("probability", F.col("z") / 5)).orderBy("video_idx").collect()
    assert [(x.node, x.flagged) for x in slots] == [("b", True), ("a", True)]
    few = r.group_scores(nodes.withColumnRenamed("z", "knn"), least=8)
    assert few.where("z <> 0").count() == 0
    decisions = spark.createDataFrame([(0, 5, 0, "a", 2.0)], KEYED + ", node string, decision double")
    over = r.trained_override(nodes.withColumn("scorer", F.lit("knn")), decisions)
    assert {(x.frame_idx, x.node): x.scorer for x in over.collect()} == {(5, "a"): "svm", (5, "b"): "knn", (2, "a"): "knn"}


def test_small_reports(spark):
    groups = spark.createDataFrame([("knn", 0), ("svm", 1), ("svm", 2), ("knn", 3)], "scorer string, place int")
    assert r.majority_scorer(groups).first().scorer == "knn"
    nodes = spark.createDataFrame([("a", [1]), ("b", [])], "node string, patch array<int>")
    assert tuple(r.coverage(nodes, ["a", "c"]).first()) == (2, 1, ["c"])
    o = spark.createDataFrame([("a", "a", 5), ("a", "b", 3), ("b", "b", 3), ("c", "c", 2)], "detector_a string, detector_b string, n int")
    assert {x.detector: x.alone for x in r.chord_remainders(o).collect()} == {"a": 2, "b": 0, "c": 2}
    frames = spark.createDataFrame([(1, True, False), (0, False, True)], "n_instances int, frame_flagged boolean, modified boolean")
    assert [r.filter_frames(frames, m).count() for m in ("all", "labeled", "flagged", "modified")] == [2, 1, 1, 1]
    assert r.missing_signals(["a", "b"], ["b"]) == ["a"]
    df = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 1, 1), (0, 2, 0, 2)], KEYED + ", place int")
    assert [x.n_siblings for x in r.siblings(df).orderBy("place").collect()] == [2, 2, 1]
    nxt = r.next_unreviewed(df, df.where("place = 1"), "place", "video_idx").orderBy("place").collect()
    assert [x.next for x in nxt] == [2, 2, 0]
    assert [x.p for x in df.select(r.queue_percentile(F.col("place"), F.lit(3)).alias("p")).collect()] == [1, 0.5, 0]


def test_focus_box(spark):
    inst = spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 2.0, 1.0), (0, 1, 1, 10.0, 10.0, 12.0, 12.0), (0, 1, 2, 90.0, 90.0, 91.0, 91.0)], KEYED + ", x0 double, y0 double, x1 double, y1 double")
    dup = spark.createDataFrame([(0, 1, 0, 1)], "video_idx int, frame_idx int, inst_a int, inst_b int")
    box = lambda worst, least=0.0: tuple(r.focus_boxes(spark.createDataFrame([(0, 1, worst)], "video_idx int, frame_idx int, worst int"), inst, dup, 2, least).first())[2:]
    assert box(0) == (0, 0, 12, 12) and box(2, 11.0) == (85, 85, 11, 11) and box(None) == (0, 0, 91, 91)


@pytest.fixture(scope="module")
def run(spark):
    return Run(derived(spark, "/root/testdata/sf0.001"), QCConfig())


def test_removal_blame(run):
    flagged = run.instance_scores.where("gmm >= 0.97").select(*KEY)
    got = r.removal_blame(flagged, run.project, run.fitted, run.mixture_fit)
    assert got.count() == flagged.count() and got.where("node between -1 and 5").count() == got.count()
    assert got.where("node >= 0").count() > 0
    blamed = r.blamed_instances(run.instance_scores, ["anomaly", "gmm"])
    assert blamed.groupBy("check").count().count() == 2


def test_rollup_ties_in_spite_of_last_bits(spark):
    rows = [(0, 1, 0, 0.9984750276493372), (0, 1, 1, 0.9984750276493374), (0, 2, 0, 1 - 2e-14), (0, 2, 1, 1 - 1e-14), (0, 3, 0, 0.5), (0, 3, 1, 0.5000001), (0, 4, 0, None), (0, 4, 1, None)]
    got = flags.rollup_max(spark.createDataFrame(rows, "video_idx int, frame_idx long, inst_idx int, anomaly double"), ["anomaly"]).collect()
    assert {r.frame_idx: (r.anomaly, r.anomaly_inst) for r in got} == {1: (0.9984750276493374, 0), 2: (1 - 1e-14, 1), 3: (0.5000001, 1), 4: (None, 0)}
