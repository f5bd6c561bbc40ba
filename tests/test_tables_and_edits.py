"""Files, labels, edits, exports, streams and whole runs."""

import pytest
from pyspark.sql import functions as F

from posekeel.config import FEATURES, QCConfig
from posekeel.operators import agreement, edits, explain, flags, labels
from posekeel.plans.engine import Run
from posekeel.plans.pose_view import KEY, derived
from posekeel.queries import QUERIES
from posekeel.sinks import exports
from posekeel.sources import projects, tables
from posekeel.streaming import rescore

SF = "/root/testdata/sf0.001"


def test_review_files(spark, tmp_path):
    (tmp_path / "all.csv").write_text('﻿frame_index,frame_idx,video,n_instances,n_faulty,status,notes\n0,5,0,2,0,ok,\n1,6,0,2,1,Faulty,"a, ""b"""\n2,6,0,2,0,ok,later\nx,y,z,,,,\n')
    review, faulty_only = tables.parse_review(tables.read_csv(spark, str(tmp_path / "all.csv")))
    got = {r.frame_idx: (r.faulty, r.notes) for r in review.collect()}
    assert not faulty_only and got == {5: (False, ""), 6: (True, 'a, "b"; later')}
    (tmp_path / "faulty.csv").write_text("frame_index,frame_idx,video,instance,bad_keypoints\n0,7,1,0,nose; tail;\n1,8,1,2,\n")
    rows = tables.read_csv(spark, str(tmp_path / "faulty.csv"))
    assert tables.parse_review(rows)[1]
    assert [(r.inst_idx, r.bad) for r in tables.parse_keypoint_labels(rows).orderBy("frame_idx").collect()] == [(0, ["nose", "tail"]), (2, [])]


def test_confusion(spark):
    rows = [(True, True)] * 3 + [(True, False)] * 1 + [(False, True)] * 2 + [(False, False)] * 4
    r = agreement.confusion(spark.createDataFrame(rows, "f boolean, t boolean"), "f", "t").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 1, 2, 4) and r.precision == 0.75 and r.recall == 0.6 and abs(r.accuracy - 0.7) < 1e-12
    assert agreement.confusion(spark.createDataFrame([], "f boolean, t boolean"), "f", "t").first().kappa == 0


def test_review_join(spark):
    frames = spark.createDataFrame([(0, 1, True), (0, 2, False)], "video_idx int, frame_idx int, f boolean")
    review = spark.createDataFrame([(0, 1, True), (0, 9, True)], "video_idx int, frame_idx int, faulty boolean")
    keys = ["video_idx", "frame_idx"]
    assert agreement.against_review(frames, review, "f", True, keys).count() == 2
    assert agreement.against_review(frames, review, "f", False, keys).count() == 1
    assert agreement.unmatched_review(frames, review, keys).first().frame_idx == 9


def test_label_log(spark):
    log = [(0, 1, 0, 1, True, ["b", "a"]), (0, 1, 0, 2, True, []), (0, 2, 0, 1, True, ["a"]), (0, 2, 0, 2, False, None)]
    got = labels.fold_log(spark.createDataFrame(log, "video_idx int, frame_idx int, inst_idx int, seq int, reviewed boolean, bad array<string>")).collect()
    assert [(r.frame_idx, r.bad) for r in got] == [(1, [])]  # still reviewed, now a negative; the other unreviewed
    emb = spark.createDataFrame([(0, 1, 0, "a"), (0, 7, 0, "a")], "video_idx int, frame_idx int, inst_idx int, node string")
    lab = spark.createDataFrame([(0, 1, 0, ["a"])], "video_idx int, frame_idx int, inst_idx int, bad array<string>")
    assert [(r.frame_idx, r.y) for r in labels.training_rows(emb, lab).collect()] == [(1, 1)]


def test_edits(spark):
    p = derived(spark, SF)
    log = spark.createDataFrame([(1, 1, 0, 0, 1, 5.0, 6.0, True), (1, 1, 0, 0, 2, 7.0, 8.0, True)], "video_idx int, frame_idx long, inst_idx int, node int, seq int, x double, y double, visible boolean")
    at = lambda cursor: edits.apply_moves(p.instances, log, 6, cursor).where("frame_idx = 1 and inst_idx = 0").first()
    assert (at(None).x0, at(1).x0) == (7.0, 5.0) and edits.is_modified(log, 1) and not edits.is_modified(log, 2)
    n = p.instances.where("frame_idx = 1").count()
    new = edits.add_instances(p.instances, p.frames.where("frame_idx = 1"), p.videos, 6).where("frame_idx = 1")
    assert new.count() == n + 1 and new.agg(F.max("inst_idx")).first()[0] == n
    assert "x5" not in edits.remove_node(p.instances, 6, 2).columns and "x6" in edits.append_node(p.instances, 6).columns
    assert edits.add_edge([(0, 1)], 1, 0) == [(0, 1)] and edits.add_edge([], 1, 1) == [] and edits.remove_edge([(0, 1)], 1, 0) == []


def test_explanations(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.88), (0.2, 9.0, 0.3)], "min_symmetry_consistency double, max_edge_zscore double, score double")
    got = explain.top_issue(df, ["min_symmetry_consistency", "max_edge_zscore"]).withColumn("word", explain.confidence_word(F.col("score"))).collect()
    assert [r.top_issue for r in got] == ["Unusual edge length"] * 2 and [r.word for r in got] == ["high", "low"]
    text = df.select(explain.with_direction(F.lit("x"), F.lit(1)).alias("a"), explain.with_direction(F.lit("x"), F.lit(0)).alias("b"), exports.number_text(F.lit(1.0)).alias("c"), exports.number_text(F.lit(float("nan"))).alias("d")).first()
    assert tuple(text) == ("x (increased)", "x", "1.0", "0.0")
    assert [x.feature for x in explain.top_contributions(df, ["min_symmetry_consistency", "max_edge_zscore"], 1).collect()[1].top] == ["max_edge_zscore"]


def test_project_round_trip(spark, tmp_path):
    data = {
        "videos": [(0, "v", 10, 480, 640, 1)], "frames": [(0, 1, None), (0, 2, True)],
        "instances": [(0, 1, 0, "t", None, [(1.0, 2.0, True, 0.5), (float("nan"), 1.0, True, 0.5), (3.0, 4.0, False, None)])],
        "skeleton_nodes": [(0, "a"), (1, "b"), (2, "c")], "skeleton_edges": [(0, 1), (1, 2)], "skeleton_symmetries": [(2, 1)],
    }
    for name, rows in data.items():
        spark.createDataFrame(rows, projects.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    p = projects.read_project(spark, str(tmp_path))
    r = p.instances.first()
    assert (r.x0, r.y0, r.x1, r.x2) == (1.0, 2.0, None, None) and p.skeleton.pairs == ((1, 2),)
    assert tuple(projects.totals(p).first()) == (1, 2, 1, 1)


@pytest.fixture(scope="module")
def run(spark):
    return Run(derived(spark, SF), QCConfig().with_feature_check("max_edge_zscore"))


def test_run(spark, run):
    scores = run.instance_scores
    assert scores.count() == run.project.instances.count()
    assert scores.where("not (anomaly between 0 and 1) or not (gmm between 0 and 1)").count() == 0
    frames = run.frames
    assert frames.count() == run.project.frames.count() and "flag_max_edge_zscore" in frames.columns
    assert 0 < frames.where("frame_flagged").count() <= frames.count()
    out = exports.qc_results(scores, frames)
    assert len(out.columns) == 27 and out.count() == scores.count()


def test_quality_run_holds_nothing(spark):
    plan = QUERIES["quality_run"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "Window" not in plan
    assert plan.count("MapInPandas") == 2  # shapes, flips and splits in one worker, the mixture in another


def test_export_of_ordering(spark):
    frames = spark.createDataFrame([(0, 1, True)], "video_idx int, frame_idx long, frame_flagged boolean")
    rows = spark.createDataFrame([(0, 1, 0, 0.5)], "video_idx int, frame_idx long, inst_idx int, anomaly double").withColumns({f: F.lit(0.0) for f in FEATURES})
    off, on = (exports.as_text(exports.qc_results(x, frames)).first() for x in (rows, rows.withColumns({"order_inversion_rate": F.lit(0.5), "chain_intersection_count": F.lit(2)})))
    assert (off.order_inversion_rate, off.chain_intersection_count) == ("0.0", "0.0") and len(off) == 27
    assert (on.order_inversion_rate, on.chain_intersection_count) == ("0.5", "2.0")


def test_queue_covers_every_instance(run):
    rows = run.instance_scores.select(*KEY, "anomaly", "gmm", F.col("max_angle_zscore").alias("angle"), F.col("mean_angle_zscore").alias("mean_angle"))
    queue = flags.proofreading_queue(rows, KEY, ["anomaly", "gmm", "angle", "mean_angle"])
    assert queue.count() == rows.count() and queue.where("evidence is null or loudest is null").count() == 0
    assert queue.where("priority").count() == queue.where("pct_angle >= 0.95").count()


def test_stream_rescore(spark, run, tmp_path):
    edited = run.project.instances.where("frame_idx < 40").withColumn("seq", F.lit(1))
    edited.write.parquet(f"{tmp_path}/edits")
    stream = spark.readStream.schema(edited.schema).parquet(f"{tmp_path}/edits")
    score = lambda batch: rescore.rescore(batch, run.project, run.fitted, run.zscore_fit, run.config)
    rescore.stream_rescore(stream, score, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = rescore.latest_scores(spark.read.parquet(f"{tmp_path}/out"))
    assert got.count() == edited.count()
    merged = rescore.upsert(run.instance_scores.select(*KEY, "anomaly"), got.select(*KEY, "anomaly"))
    assert merged.count() == run.instance_scores.count()
