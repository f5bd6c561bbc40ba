"""Mixtures, flips, splits, embeddings and classifiers."""

import json
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from posekeel.functions.numeric import hull_batch, hull_measures
from posekeel.operators import embeddings as e
from posekeel.operators import mixture, structure, svm
from posekeel.operators.structure import Chirality, split_by_distance
from posekeel.skeleton import Skeleton
from posekeel.sources import bundles


def judge_chirality(pose, model):
    score, node = structure.judge_chirality(np.stack([pose, pose]), model)
    assert score[0] == score[1] and node[0] == node[1]
    return float(score[0]), int(node[0])


def split_pose(pose, skeleton, lengths):
    got = structure.split_poses(np.stack([np.full_like(pose, np.nan), pose]), skeleton, lengths)
    assert got["score"][0] == 0 and got["bridge"][0].tolist() == [-1, -1]
    bridge = tuple(got["bridge"][1].tolist())
    return SimpleNamespace(score=got["score"][1], ratio=got["ratio"][1], gap=got["gap"][1], bridge=bridge if bridge[0] >= 0 else None)


def test_scaler_and_density():
    mean, scale = mixture.scaler(np.array([[0.0], [2.0]]))
    assert mean[0] == 1 and scale[0] == 1
    one = mixture.Mixture(np.ones(1), np.zeros((1, 2)), np.eye(2)[None])
    assert abs(one.log_likelihood(np.zeros((1, 2)))[0] + math.log(2 * math.pi)) < 1e-12
    two = mixture.Mixture(np.ones(1), np.zeros((1, 2)), np.array([[[2.0, 1], [1, 2]]]))
    assert abs(two.log_likelihood(np.ones((1, 2)))[0] + 0.5 * (2 * math.log(2 * math.pi) + math.log(3) + 2 / 3)) < 1e-12


def test_mixture_outliers():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (60, 2))
    a, b = (mixture.fit_outliers(x, ["p", "q"]) for _ in range(2))
    far = np.array([[100.0, 100.0]])
    assert a.score(far)[0] > 0.99 and np.array_equal(a.score(x), b.score(x))
    assert a.blame(np.array([[50.0, 0.0]]))[1][0] == 0
    with pytest.raises(ValueError):
        mixture.fit_outliers(np.array([[np.nan, 1.0], [1.0, 2.0]]), ["p", "q"])


def test_likelihood_never_falls():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (80, 3)), rng.normal(5, 1, (80, 3))])
    model = mixture.maximise(x, np.eye(2)[rng.integers(0, 2, 160)], 1e-6)
    last = -np.inf
    for _ in range(20):
        now = model.log_likelihood(x).mean()
        assert now >= last - 1e-9
        last = now
        parts = model.log_parts(x)
        model = mixture.maximise(x, np.exp(parts - model.log_likelihood(x)[:, None]), 1e-6)


def test_leave_one_node_out():
    rng = np.random.default_rng(0)
    model = mixture.fit_outliers(rng.normal(size=(100, 2)), ["p", "q"])
    assert mixture.leave_one_node_out(model, np.array([[50.0, 0.0]]), np.array([[[50.0, 0.0], [0.0, 0.0]]])).tolist() == [1]


BODY = Skeleton(("a", "b", "c", "e", "ear_l", "ear_r", "paw_l", "paw_r"), ((0, 1), (1, 2), (2, 3)))


def body(flip=()):
    pose = np.array([(0, 0), (10, 0), (20, 0), (30, 0), (5, 5), (5, -5), (25, 5), (25, -5)], float)
    for a, b in flip:
        pose[[a, b]] = pose[[b, a]]
    return pose


def test_chirality():
    pairs = tuple(BODY.side_pairs())
    assert pairs == ((4, 5), (6, 7)) and BODY.midline() == [0, 1, 2, 3]
    model = Chirality(pairs, (0, 1, 2, 3), {0: 1, 1: 1})
    assert judge_chirality(body(), model) == (0.0, -1)
    assert judge_chirality(body(pairs), model) == (1.0, 4)
    assert judge_chirality(body(pairs[:1]), model) == (0.9, 4)
    hidden = body(pairs)
    hidden[7] = np.nan
    assert judge_chirality(hidden, model)[0] == 0
    turn = np.array([[0.6, -0.8], [0.8, 0.6]])
    assert judge_chirality(body(pairs) @ turn, model)[0] == 1.0


def test_midline_order():
    total, count = structure.midline_ranks(np.stack([body(), body()]), [3, 0, 2, 1])
    assert np.argsort(total[:4]).tolist() == [0, 1, 2, 3] and count[:4].tolist() == [2] * 4 and not count[4:].any()


CHAIN6 = Skeleton(tuple("abcdef"), tuple((i, i + 1) for i in range(5)))
LENGTHS = {(i, i + 1): (10.0, 1.0) for i in range(5)}


def test_split():
    apart = np.array([(0, 0), (10, 0), (20, 0), (320, 0), (330, 0), (340, 0)], float)
    got = split_pose(apart, CHAIN6, LENGTHS)
    assert got.score > 1 and got.ratio == 0.5 and got.gap > 10 and got.bridge == (2, 3)
    stray = np.array([(0, 0), (10, 0), (20, 0), (30, 0), (40, 0), (500, 0)], float)
    assert split_pose(stray, CHAIN6, LENGTHS).ratio < 0.2 and split_pose(stray, CHAIN6, LENGTHS).score == 0
    few = apart.copy()
    few[3:] = np.nan
    assert split_pose(few, CHAIN6, LENGTHS).score == 0
    assert split_by_distance(apart).score > 1


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(0, 0.05, (40, 24)) + 1
    far = rng.normal(0, 1, (3, 24))
    x = np.concatenate([near, far])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, grp int, emb array<double>")


def test_knn_outliers(vectors):
    x, df = vectors
    got = {r.id: r.knn for r in e.knn_outlier(df, df, "id", "emb").collect()}
    assert set(sorted(got, key=got.get)[-3:]) == {40, 41, 42}
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    assert np.allclose([got[i] for i in range(43)], np.sort(d, 1)[:, :6].mean(1))
    assert e.knn_outlier(df, df.limit(1), "id", "emb").where("knn <> 0").count() == 0


def test_reference_per_group(spark):
    rows = [(i, g) for g, n in (("a", 100), ("b", 30), ("c", 5)) for i in range(n)]
    got = e.stratified_reference(spark.createDataFrame(rows, "i int, g string"), "g", "i", 0.2, 10).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 20, "b": 10, "c": 5}


def test_pca(spark):
    rng = np.random.default_rng(1)
    factors = rng.normal(size=(80, 2)) * [5, 2]
    x = factors @ rng.normal(size=(2, 20)) + rng.normal(0, 0.01, (80, 20))
    got = e.pca2(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "id", "v").orderBy("id").toPandas()
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for c, k in (("pc1", 0), ("pc2", 1)):
        assert abs(np.corrcoef(got[c], u[:, k] * s[k])[0, 1]) > 0.999


@pytest.mark.parametrize(("budget", "size"), [(1, 1), (7, 7), (13, 13), (39, 39), (100, 40)])
def test_memory_bank(budget, size):
    tokens = [e.tokens_of(np.random.default_rng(i).normal(size=32), 4) for i in range(10)]
    bank, owners = e.memory_bank(tokens, list(range(10)), budget)
    assert len(bank) == len(owners) == size


def test_patches():
    rng = np.random.default_rng(2)
    packed = e.pack_tokens(rng.normal(size=(256, 48)), dim=16)
    assert packed.shape == (16, 16) and packed.dtype == np.int8
    assert np.allclose(np.linalg.norm(e.unpack_tokens(packed, 16), axis=1), 1)
    assert e.pack_tokens(rng.normal(size=(7, 4))) is None
    assert e.top_mean(np.array([1.0, 2, 3, 4])) == 4 and e.top_mean(np.zeros(0)) == 0


def blobs(gap, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(gap, 1, (20, 16)), rng.normal(0, 1, (60, 16))])
    return x, np.array([1] * 20 + [-1] * 60)


def test_svm_learns_blobs_not_noise():
    x, y = blobs(2.5)
    model, report = svm.fit_svm(x, y)
    assert report.roc > 0.9 and report.warning is None and ((model.decision(x) > 0) == (y > 0)).mean() > 0.95
    assert 0.2 < svm.fit_svm(*blobs(0))[1].roc < 0.8
    with pytest.raises(ValueError):
        svm.fit_svm(x, np.ones(80))


def test_svm_round_trip(spark):
    x, y = blobs(2.0, 1)
    model, report = svm.fit_svm(x, y)
    back, about = svm.loads(svm.dumps(model, node="nose", roc=report.roc), dim=16)
    assert np.allclose(back.probability(x), model.probability(x), atol=1e-9) and about["node"] == "nose"
    for change in ({"format": "x"}, {"version": 9}, {"dual": [1.0]}, {"gamma": None}):
        with pytest.raises(ValueError):
            svm.loads(json.dumps(json.loads(svm.dumps(model)) | change))
    with pytest.raises(ValueError):
        svm.loads(svm.dumps(model), dim=3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = svm.svm_scores(df, model, "v").orderBy("id").toPandas()
    assert np.allclose(got["decision"], model.decision(x))


def test_bundles(spark, tmp_path):
    emb = np.arange(6, dtype="f4").reshape(2, 3)
    header = {"kind": "nose-emb", "dim": 3, "n": 2, "video": [0, 1], "frame_idx": [5, 6], "inst": [0, 2], "node_min": 24}
    (tmp_path / "a.bin").write_bytes(bundles.join_bundle(header, emb.ravel()))
    rows = bundles.read_embedding_bundles(spark, str(tmp_path)).orderBy("video_idx").collect()
    assert [(r.frame_idx, r.inst_idx, list(r.emb)) for r in rows] == [(5, 0, [0, 1, 2]), (6, 2, [3, 4, 5])]
    assert bundles.check_match(header, 3, 32.0) and not bundles.check_match(header, 3, 24)
    for bad in (b"", b"\x09\0\0\0{}", bundles.join_bundle(header, emb.ravel()[:4])):
        with pytest.raises(ValueError):
            bundles.embedding_rows(bad)
    model = {"kind": "nose-model", "dim": 2, "n_sv": 1, "gamma": 0.5, "intercept": 0.1}
    got = bundles.read_model_bundle(bundles.join_bundle(model, np.array([0, 0, 1, 1, 2, 3, 4], "f4")))
    assert got.dual.tolist() == [2] and got.vectors.tolist() == [[3, 4]]


def test_prototype(vectors):
    x, df = vectors
    w = e.prototype(df, F.col("id") >= 40, F.col("grp") == 0, "emb")
    assert abs(np.linalg.norm(w) - 1) < 1e-9
    got = {r.id: r.prototype for r in e.prototype_scores(df, w, "emb").collect()}
    assert min(got[i] for i in (40, 41, 42)) > max(got[i] for i in range(40))
    assert e.prototype(df, F.lit(False), F.lit(True), "emb") is None
    assert e.rank_blend(df.withColumn("s", F.col("id") * 2.0), "id", "s", 0).where("blend <> id").count() == 0


def test_hulls_of_batches():
    rnd = np.random.default_rng(2)
    poses = rnd.normal(size=(300, 9, 2)) * 50
    poses[rnd.random((300, 9)) < 0.3] = np.nan
    poses[:40] = np.round(poses[:40] / 40)  # points in line, and equal ones
    area, compact = hull_batch(poses)
    for p, a, c in zip(poses, area, compact):
        one = hull_measures(p[~np.isnan(p).any(1)])
        assert math.isclose(a, one["area"], abs_tol=1e-9) and math.isclose(c, one["compactness"], abs_tol=1e-9)


def test_appearance_falls_back_and_says_so(spark):
    df = spark.createDataFrame([(i, [1.0, float(i), 0.0]) for i in range(12)], "vec_id long, v array<double>")
    assert {r.scorer for r in e.appearance_scores(df, df, "vec_id", "v", 2).collect()} == {"knn"}
    assert {r.scorer for r in e.appearance_scores(df, df, "vec_id", "v", 3).collect()} == {"patch"}


def test_packed_tokens(spark):
    df = spark.createDataFrame([(1, [float(i % 5) for i in range(32)]), (2, None)], "vec_id long, v array<double>")
    got = {r.vec_id: r for r in e.unpacked(e.packed(df, "v", 4, 2, 8), dim=8).collect()}
    assert len(got[1].packed) == 32 and got[2].packed is None and got[2].tokens is None
    assert np.allclose(np.square(np.reshape(got[1].tokens, (4, 8))).sum(1), 1)
