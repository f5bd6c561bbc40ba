"""Left/right flips and split poses: geometry of whole Arrow batches, taken
by groups of poses with the same visible nodes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posekeel.functions.columns import Step, stepped
from posekeel.functions.numeric import pca_axes, visibility_groups
from posekeel.operators.features import pose_array
from posekeel.skeleton import Skeleton, parts_without_edge

# ------------------------------------------------------------------ chirality

#: fixed values: least lateral share and least straddle balance of a pair
MIN_LATERAL, MIN_STRADDLE = 0.2, 0.15


def midlines(poses: np.ndarray, nodes: np.ndarray, midline: Sequence[int], sided: Sequence[int]) -> tuple[np.ndarray, np.ndarray] | None:
    """Polylines along the visible midline nodes, else the main axis of the
    visible nodes that are on no side; and which poses have one."""
    line = [i for i in midline if i in nodes]
    if len(line) >= 2:
        return poses[:, line], np.ones(len(poses), bool)
    rest = [i for i in nodes if i not in sided]
    if len(rest) < 2:
        return None
    origin, way, spread = pca_axes(poses[:, rest])
    return np.stack([origin, origin + way], 1), spread


def sides_of_pair(left: np.ndarray, right: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """+1 or -1 for the side the left node is on, 0 if the pair does not tell."""
    step = np.diff(lines, axis=1)
    length = (step**2).sum(2)
    ok = length >= 1e-12
    middle = ((left + right) / 2)[:, None]
    t = np.clip(((middle - lines[:, :-1]) * step).sum(2) / np.where(ok, length, 1), 0, 1)
    feet = lines[:, :-1] + t[:, :, None] * step
    apart = np.where(ok, ((middle - feet) ** 2).sum(2), np.inf)
    row, k = np.arange(len(lines)), apart.argmin(1)
    foot, along = feet[row, k], step[row, k] / np.sqrt(np.where(ok[row, k], length[row, k], 1))[:, None]
    across = lambda p: along[:, 0] * (p[:, 1] - foot[:, 1]) - along[:, 1] * (p[:, 0] - foot[:, 0])
    sl, sr, reach = across(left), across(right), np.hypot(*(left - foot).T)
    wide = np.abs(sl - sr)
    tells = ok.any(1) & (reach >= 1e-9) & (np.abs(sl) >= MIN_LATERAL * reach) & (sl * sr < 0) & (wide >= 1e-9)
    tells &= np.minimum(np.abs(sl), np.abs(sr)) >= MIN_STRADDLE * wide
    return np.where(tells, np.sign(sl), 0).astype(int)


@dataclass(frozen=True)
class Chirality:
    """Learned side of each pair that ever told one, and the midline order."""

    pairs: tuple[tuple[int, int], ...]
    midline: tuple[int, ...]
    side: dict[int, int]


def midline_ranks(poses: np.ndarray, midline: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts, for each node, of its rank from 0 to 1 among the visible
    midline nodes along a pose's axis, turned so that the first has the lower
    index."""
    total, count = np.zeros(poses.shape[1]), np.zeros(poses.shape[1], int)
    for rows, nodes in visibility_groups(poses):
        line = np.array([i for i in midline if i in nodes], int)
        if len(line) < 2:
            continue
        p = poses[rows]
        origin, way, spread = pca_axes(p[:, nodes])
        order = np.argsort(((p[:, line] - origin[:, None]) * way[:, None]).sum(2), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        turned = line[order[:, 0]] > line[order[:, -1]]
        place = np.where(turned[:, None], len(line) - 1 - place, place)[spread]
        total[line] += place.sum(0) / (len(line) - 1)
        count[line] += len(place)
    return total, count


def fit_chirality(instances: DataFrame, s: Skeleton) -> Chirality | None:
    """Two small aggregations: mean ranks give the midline order, mean sides the
    usual side of each pair (ties are +1)."""
    pairs, midline, n = s.side_pairs(), s.midline(), s.n_nodes
    if not pairs:
        return None
    sided = {i for p in pairs for i in p}

    def ranks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total, count = midline_ranks(pose_array(frame, n), midline)
            yield pd.DataFrame({"node": np.arange(n), "total": total, "c": count})[count > 0]

    order = midline
    if len(midline) >= 2:
        got = {r["node"]: r["m"] for r in instances.mapInPandas(ranks, "node int, total double, c long").groupBy("node").agg((F.sum("total") / F.sum("c")).alias("m")).collect()}
        if got:
            order = sorted(midline, key=lambda i: got.get(i, 0.0))

    def sides(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = _sides(pose_array(frame, n), pairs, order, sided)
            yield pd.DataFrame({"pair": np.arange(len(pairs)), "total": told.sum(0)})[(told != 0).any(0)]

    got = instances.mapInPandas(sides, "pair int, total long").groupBy("pair").agg(F.sum("total").alias("t")).collect()
    return Chirality(tuple(pairs), tuple(order), {r["pair"]: 1 if r["t"] >= 0 else -1 for r in got})


def _sides(poses: np.ndarray, pairs: Sequence[tuple[int, int]], midline: Sequence[int], sided: set[int]) -> np.ndarray:
    """Side of each pair (columns) in each pose, 0 where it does not tell."""
    out = np.zeros((len(poses), len(pairs)), int)
    for rows, nodes in visibility_groups(poses):
        p = poses[rows]
        found = midlines(p, nodes, midline if len(midline) >= 2 else [], sorted(sided))
        if found is None:
            continue
        lines, has = found
        for k, (a, b) in enumerate(pairs):
            if a in nodes and b in nodes:
                out[rows, k] = np.where(has, sides_of_pair(p[:, a], p[:, b], lines), 0)
    return out


def judge_chirality(poses: np.ndarray, model: Chirality) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and a node of the first wrong pair or -1.  Half or more wrong is
    0.9 at least; too few telling pairs are no evidence."""
    told = _sides(poses, model.pairs, model.midline, {i for p in model.pairs for i in p})
    usual = np.array([model.side.get(k, 0) for k in range(len(model.pairs))], int)
    known = (told != 0) & (usual != 0)
    wrong = known & (told != usual)
    number = known.sum(1)
    share = wrong.sum(1) / np.maximum(number, 1)
    enough = number >= min(2, len(model.side) or 2)
    first = np.array([min(p) for p in model.pairs], int)
    node = np.where(wrong, first, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
    score = np.where(share >= 0.5, np.maximum(0.9, share), share)
    return np.where(enough, score, 0.0), np.where(enough & wrong.any(1), node, -1)


def chirality_step(model: Chirality | None, n: int) -> Step:
    """Adds chirality and chirality_node."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score, node = judge_chirality(pose_array(frame, n), model) if model else (np.zeros(len(frame)), np.full(len(frame), -1))
            yield frame.assign(chirality=score, chirality_node=node.astype(np.int32))

    return run, {"chirality": T.DoubleType(), "chirality_node": T.IntegerType()}


def chirality_scores(instances: DataFrame, model: Chirality | None, n: int) -> DataFrame:
    return stepped(instances, chirality_step(model, n))


# ----------------------------------------------------------------- split poses

#: fixed values: balance ramp, least gap and least silhouette
BALANCE, MIN_GAP, MIN_SILHOUETTE, MIN_NODES, TINY = (0.18, 0.30), 1.5, 0.5, 4, 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.hypot(*(a[:, None, :] - b[None, :, :]).transpose(2, 0, 1))


def two_groups(p: np.ndarray) -> np.ndarray:
    """Two-means from the two points farthest apart (first such pair)."""
    d = ((p[:, None, :] - p[None, :, :]) ** 2).sum(2)
    upper = np.triu(d, 1)
    upper[np.tril_indices(len(p))] = -1
    a, b = (p[i] for i in np.unravel_index(upper.argmax(), upper.shape))
    label = np.zeros(len(p), int)
    for _ in range(50):
        new = (((p - a) ** 2).sum(1) > ((p - b) ** 2).sum(1)).astype(int)
        same, label = (new == label).all(), new
        if label.all() or not label.any():
            break
        a, b = p[label == 0].mean(0), p[label == 1].mean(0)
        if same:
            break
    return label


def silhouette(a: np.ndarray, b: np.ndarray) -> float:
    scores = []
    for own, other in ((a, b), (b, a)):
        near = distances(own, own).sum(1) / max(len(own) - 1, 1)
        far = distances(own, other).mean(1)
        top = np.maximum(near, far)
        scores += np.where(top > TINY, (far - near) / np.where(top > TINY, top, 1), 0).tolist()
    return float(np.mean(scores))


def _balance(share: float) -> float:
    return float(np.clip((share - BALANCE[0]) / (BALANCE[1] - BALANCE[0]), 0, 1))


@dataclass(frozen=True)
class Split:
    score: float = 0.0
    ratio: float = 0.0
    gap: float = 0.0


def split_by_distance(p: np.ndarray) -> Split:
    """Without a telling skeleton: two clusters with a gap between them."""
    if len(p) < MIN_NODES:
        return Split()
    label = two_groups(p)
    a, b = p[label == 0], p[label == 1]
    if not len(a) or not len(b):
        return Split()
    inner = []
    for own in (a, b):
        if len(own) > 1:
            d = distances(own, own)
            np.fill_diagonal(d, np.inf)
            inner += d.min(1).tolist()
    gap = distances(a, b).min() / max(float(np.median(inner)) if inner else 0.0, TINY)
    share = min(len(a), len(b)) / len(p)
    score = _balance(share) * max(gap - MIN_GAP, 0) if silhouette(a, b) >= MIN_SILHOUETTE else 0.0
    return Split(score, share, gap)


def split_poses(poses: np.ndarray, s: Skeleton, lengths: dict[tuple[int, int], tuple[float, float]]) -> dict[str, np.ndarray]:
    """How much each pose looks like parts of two animals joined by one
    over-stretched edge: score, ratio, gap and bridge (-1 without one).
    ``lengths`` are mean and deviation of each edge."""
    m = len(poses)
    out = {"score": np.zeros(m), "ratio": np.zeros(m), "gap": np.zeros(m), "bridge": np.full((m, 2), -1)}
    for rows, nodes in visibility_groups(poses):
        if len(nodes) < MIN_NODES:
            continue
        p, held = poses[rows], set(nodes.tolist())
        edges = list(dict.fromkeys((min(i, j), max(i, j)) for i in nodes.tolist() for j in s.neighbours[i] if j in held))
        known = [e for e in edges if e in lengths]
        degree = [sum(i in e for e in edges) for i in held]
        star = bool(edges) and max(degree) >= max(len(nodes) - 1, len(edges) - 1)
        if not known or len(edges) < 2 or star:
            for r, pose in zip(rows, p[:, nodes]):
                got = split_by_distance(pose)
                out["score"][r], out["ratio"][r], out["gap"][r] = got.score, got.ratio, got.gap
            continue
        ends = np.array(known)
        usual = np.array([lengths[e] for e in known])
        z = (np.hypot(*np.moveaxis(p[:, ends[:, 0]] - p[:, ends[:, 1]], 2, 0)) - usual[:, 0]) / np.maximum(usual[:, 1], TINY)
        widest = z.argmax(1)
        for k in np.unique(widest):
            parts = parts_without_edge(nodes.tolist(), edges, known[k])
            if len(parts) != 2:
                continue
            at = np.flatnonzero(widest == k)
            a, b = (p[at][:, list(x)] for x in parts)
            share = min(a.shape[1], b.shape[1]) / len(nodes)
            centres = a.mean(1), b.mean(1)
            around = [np.hypot(*np.moveaxis(x - c[:, None], 2, 0)).mean(1) if x.shape[1] > 1 else np.zeros(len(at)) for x, c in zip((a, b), centres)]
            gap = np.hypot(*(centres[0] - centres[1]).T) / np.maximum(np.maximum(*around), TINY)
            out["score"][rows[at]] = np.maximum(z[at, k], 0) * _balance(share) * np.maximum(gap - MIN_GAP, 0)
            out["ratio"][rows[at]], out["gap"][rows[at]], out["bridge"][rows[at]] = share, gap, known[k]
    return out


def split_step(s: Skeleton, stats: dict[str, float]) -> Step:
    """Adds pose_split (score / (score + 1)), split_raw and the bridge's nodes
    (-1 without one)."""
    lengths = {(min(e), max(e)): (stats[f"m_d_{min(e)}_{max(e)}"], stats[f"s_d_{min(e)}_{max(e)}"]) for e in s.edges}
    n = s.n_nodes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = split_poses(pose_array(frame, n), s, lengths)
            bridge = got["bridge"].astype(np.int32)
            yield frame.assign(pose_split=got["score"] / (got["score"] + 1), split_raw=got["score"], bridge_a=bridge[:, 0], bridge_b=bridge[:, 1])

    return run, {"pose_split": T.DoubleType(), "split_raw": T.DoubleType(), "bridge_a": T.IntegerType(), "bridge_b": T.IntegerType()}


def split_scores(instances: DataFrame, s: Skeleton, stats: dict[str, float]) -> DataFrame:
    return stepped(instances, split_step(s, stats))
