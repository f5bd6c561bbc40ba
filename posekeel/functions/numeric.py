"""Small numeric algorithms in NumPy for vectorised functions and driver fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def seeded_uniforms(seed: int) -> Iterator[float]:
    """The 32-bit generator whose draws saved models depend on.  Its increment
    and shifts are fixed values."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & 0xFFFFFFFF
        yield (t ^ (t >> 14)) / 4294967296


def seeded_normals(seed: int, n: int) -> np.ndarray:
    """Pairs of normals from pairs of uniforms."""
    draw = seeded_uniforms(seed)
    u = np.array([next(draw) for _ in range(n + n % 2)]).reshape(-1, 2)
    radius = np.sqrt(-2 * np.log(np.maximum(1e-12, u[:, 0])))
    turn = 2 * np.pi * u[:, 1]
    return np.stack([radius * np.cos(turn), radius * np.sin(turn)], 1).ravel()[:n]


def robust_z(x: Sequence[float]) -> np.ndarray:
    """Distance from the median in scaled median deviations, floor 1e-9."""
    x = np.asarray(x, float)
    middle = np.median(x)
    return (x - middle) / (1.4826 * (np.median(np.abs(x - middle)) or 1e-9))


def rank_normalise(x: Sequence[float]) -> np.ndarray:
    """Ranks from 0 to 1, ties averaged; not finite 0; one value alone 0.5."""
    x = np.asarray(x, float)
    out = np.zeros(len(x))
    ok = np.isfinite(x)
    v = x[ok]
    if len(v):
        low = np.searchsorted(np.sort(v), v, "left")
        high = np.searchsorted(np.sort(v), v, "right") - 1
        out[ok] = (low + high) / 2 / (len(v) - 1) if len(v) > 1 else 0.5
    return out


def roc_auc(scores: Sequence[float], labels: Sequence[int]) -> float | None:
    y = np.asarray(labels) > 0
    pos, neg = int(y.sum()), int((~y).sum())
    if not pos or not neg:
        return None
    s = np.sort(scores)
    rank = (np.searchsorted(s, scores, "left") + np.searchsorted(s, scores, "right") + 1) / 2
    return float((rank[y].sum() - pos * (pos + 1) / 2) / (pos * neg))


def average_precision(scores: Sequence[float], labels: Sequence[int]) -> float | None:
    order = np.argsort(-np.asarray(scores, float), kind="stable")
    y = (np.asarray(labels) > 0)[order]
    if not y.any():
        return None
    return float((np.cumsum(y) / np.arange(1, len(y) + 1))[y].mean())


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, none on a straight side."""
    pts = sorted(map(tuple, points))

    def side(source) -> list:
        out: list = []
        for p in source:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(side(pts) + side(reversed(pts))) if len(pts) >= 3 else np.array(pts)


def hull_measures(points: np.ndarray) -> dict[str, float]:
    """Area, perimeter, aspect ratio, compactness and corners of the hull of
    the visible points; all nothing with fewer than three corners."""
    flat = {"area": 0.0, "perimeter": 0.0, "aspect": 1.0, "compactness": 0.0, "corners": float(len(points))}
    if len(points) < 3:
        return flat
    h = hull(points)
    if len(h) < 3:
        return flat | {"corners": 0.0}
    nxt = np.roll(h, -1, 0)
    area = abs(float((h[:, 0] * nxt[:, 1] - nxt[:, 0] * h[:, 1]).sum())) / 2
    around = float(np.hypot(*(nxt - h).T).sum())
    width, height = np.ptp(h, axis=0)
    return {
        "area": area, "perimeter": around, "aspect": float(width / height) if height > 0 else 1.0,
        "compactness": 4 * np.pi * area / around**2 if around > 0 else 0.0, "corners": float(len(h)),
    }


def visibility_groups(poses: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, nodes) for each set of visible nodes that occurs in some poses:
    within a group, geometry is arrays without gaps."""
    ok = ~np.isnan(poses).any(2)
    kinds, which = np.unique(ok, axis=0, return_inverse=True)
    for k, visible in enumerate(kinds):
        yield np.flatnonzero(which.ravel() == k), np.flatnonzero(visible)


#: points up to which hulls are found by testing all pairs at once, and numbers
#: of one such test
PAIRED_POINTS, PAIRED_CELLS = 16, 1 << 21


def hull_batch(poses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Area and compactness of the hull of each pose's visible points.  A side
    of the hull is a pair with all other points on its left, or between the two;
    poses in which three points are nearly in a line, or two are one, go through
    ``hull_measures``."""
    area, compact = np.zeros(len(poses)), np.zeros(len(poses))
    for rows, nodes in visibility_groups(poses):
        n = len(nodes)
        if n < 3:
            continue
        step = max(1, PAIRED_CELLS // n**3) if n <= PAIRED_POINTS else len(rows)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            p = poses[part][:, nodes]
            rest = np.ones(len(part), bool)
            if n <= PAIRED_POINTS:
                d = p[:, None, :, :] - p[:, :, None, :]  # from point i to point j
                side = d[:, :, :, None, 0] * d[:, :, None, :, 1] - d[:, :, :, None, 1] * d[:, :, None, :, 0]
                i, j, k = np.ogrid[:n, :n, :n]
                same = (i == j) | (i == k) | (j == k)
                apart = np.square(d).sum(3)
                size = apart.max((1, 2))
                inline = (side == 0) & ~same
                rest = (np.where(same | inline, np.inf, np.abs(side)).min((1, 2, 3)) <= 1e-9 * size) | ((apart == 0).sum((1, 2)) > n)
                left = same | (side > 0)
                lined = np.flatnonzero(inline.any((1, 2, 3)))
                if len(lined):  # of points in a line, those between the two are no corners
                    e = d[lined]
                    between = (e[:, :, None, :, :] * e[:, None, :, :, :]).sum(4) < 0  # seen from i and j, k is in opposite directions
                    left[lined] |= inline[lined] & between
                edge = left.all(3) & (np.arange(n)[:, None] != np.arange(n))
                cross = p[:, :, None, 0] * p[:, None, :, 1] - p[:, None, :, 0] * p[:, :, None, 1]
                whole = np.abs((cross * edge).sum((1, 2))) / 2
                around = (np.sqrt(apart) * edge).sum((1, 2))
                area[part] = whole
                compact[part] = np.where(around > 0, 4 * np.pi * whole / np.where(around > 0, around, 1) ** 2, 0.0)
            for r in np.flatnonzero(rest):
                got = hull_measures(p[r])
                area[part[r]], compact[part[r]] = got["area"], got["compactness"]
    return area, compact


def normalised_pose(xy: np.ndarray) -> np.ndarray:
    """Poses (n, nodes, 2) centred on their visible mean and divided by the
    diagonal of their box (1 if under 1e-6); missing nodes stay missing, and
    poses with fewer than two visible nodes stay as they are."""
    seen = ~np.isnan(xy).any(2)
    few = seen.sum(1) < 2
    masked = np.where(seen[:, :, None], xy, np.nan)
    safe = np.where(few[:, None, None], 0.0, masked)
    centre = np.nanmean(safe, axis=1, keepdims=True)
    scale = np.hypot(*(np.nanmax(safe, axis=1) - np.nanmin(safe, axis=1)).T)
    scale = np.where(scale < 1e-6, 1.0, scale)[:, None, None]
    return np.where(few[:, None, None], xy, (masked - centre) / scale)


def pca_axes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and main direction of each of some point sets (m, points, 2), and
    whether they spread at all."""
    origin = points.mean(1)
    c = points - origin[:, None]
    xx, yy, xy = (c[:, :, 0] ** 2).mean(1), (c[:, :, 1] ** 2).mean(1), (c[:, :, 0] * c[:, :, 1]).mean(1)
    top = (xx + yy) / 2 + np.sqrt(np.maximum(0.0, (xx + yy) ** 2 / 4 - (xx * yy - xy * xy)))
    flat = np.where((xx >= yy)[:, None], [1.0, 0.0], [0.0, 1.0])
    v = np.where((np.abs(xy) > 1e-12)[:, None], np.stack([top - yy, xy], 1), flat)
    size = np.hypot(v[:, 0], v[:, 1])
    spread = (np.abs(c).max((1, 2)) >= 1e-6) & (size >= 1e-6)
    return origin, v / np.where(spread, size, 1)[:, None], spread
