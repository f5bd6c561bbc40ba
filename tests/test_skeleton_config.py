"""Skeleton analysis and settings: closed-form cases."""

import json

import pytest

from posekeel.config import QCConfig, merge_config
from posekeel.skeleton import Skeleton, linear_runs, pairs_by_name, parts_without_edge
from posekeel.sources.projects import is_pose_file


def mouse():
    """Nose hub with two ears and a tail of four."""
    return Skeleton(tuple("abcdefg"), ((0, 1), (1, 4), (0, 2), (0, 3), (4, 5), (5, 6)))


def test_degree_and_spine():
    s = mouse()
    assert s.degree == (3, 2, 1, 1, 2, 2, 1)
    assert len(s.spine) == 6 and set(s.spine) >= {0, 1, 4, 5, 6}
    assert s.branch_points == [0] and s.endpoints == [2, 3, 6]
    assert Skeleton(tuple("abcd"), ((0, 1), (1, 2), (2, 3))).spine == [0, 1, 2, 3]
    assert Skeleton((), ()).spine == []


def test_chains():
    chains = mouse().chains()
    assert [0, 1, 4, 5, 6] in [c if c[0] == 0 else c[::-1] for c in chains]
    assert linear_runs([[0, 1, 2, 3]], [2, 3, 2, 1]) == [[1, 2, 3]]
    assert linear_runs([[0, 1]], [1, 1]) == []
    chain = Skeleton(tuple("abcd"), ((0, 1), (1, 2), (2, 3)))
    assert chain.ordered_chains([["a", "c", "d"], ["a", "zz"]]) == [[0, 2, 3]]
    assert chain.ordered_chains() == [[0, 1, 2, 3]]


def test_side_names():
    assert pairs_by_name(["nose", "tail", "Ear_L", "Ear_R", "Eye_R", "Paw_L", "Paw_R"]) == [(2, 3), (5, 6)]
    assert pairs_by_name(["left hand", "right hand", "hand-left", "hand-right"]) == [(0, 1), (2, 3)]
    assert pairs_by_name(["L_ear", "R_ear"]) == [(0, 1)] or pairs_by_name(["L_ear", "R_ear"]) == []
    assert pairs_by_name([]) == []


def test_parts_without_edge():
    assert parts_without_edge([0, 1, 2, 3], [(0, 1), (1, 2), (2, 3)], (1, 2)) == [[0, 1], [2, 3]]


def test_settings_merge():
    saved = json.loads(QCConfig(threshold=0.5).with_feature_check("nn_distance", 2.5).dumps())
    saved |= {"checks": {"count": True, "nope": True}, "sparse_fraction": "x", "stale": 1}
    config, restored, dropped = merge_config(saved)
    assert config.threshold == 0.5 and config.checks["count"] and config.feature_checks[0].threshold == 2.5
    assert {"sparse_fraction", "stale", "checks.nope"} <= set(dropped) and "threshold" in restored
    assert merge_config(None)[0] == QCConfig()
    assert QCConfig().needs_refit(QCConfig(baseline_source="user")) and not QCConfig().needs_refit(QCConfig(threshold=0.1))
    with pytest.raises(KeyError):
        QCConfig().with_check("nope", True)


def test_pose_files():
    assert is_pose_file("a.slp") and is_pose_file("a.pkg.SLP") and not is_pose_file("a.slp.txt")
