"""RBF support vector classifier: driver fit on labelled rows, batch scoring."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from posekeel.functions.columns import schema_with
from posekeel.functions.numeric import average_precision, roc_auc

#: a cross-validated figure with fewer faulty rows is noise
MIN_POSITIVES = 8
FORMAT, VERSION = "posekeel-svm", 1


@dataclass(frozen=True)
class Svm:
    mean: np.ndarray
    scale: np.ndarray
    gamma: float
    intercept: float
    dual: np.ndarray
    vectors: np.ndarray
    threshold: float = 0.0
    platt: tuple[float, float] | None = None

    @property
    def dim(self) -> int:
        return len(self.mean)

    def decision(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float) - self.mean) / self.scale
        d = (z**2).sum(1)[:, None] + (self.vectors**2).sum(1)[None, :] - 2 * z @ self.vectors.T
        return np.exp(-self.gamma * np.maximum(d, 0)) @ self.dual + self.intercept

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; the raw decision if not calibrated."""
        f = self.decision(x)
        return f if self.platt is None else 1 / (1 + np.exp(-(self.platt[0] * f + self.platt[1])))


def solve(kernel: np.ndarray, y: np.ndarray, bound: np.ndarray, tolerance: float = 1e-3, quiet: int = 12, most: int = 6000) -> tuple[np.ndarray, float]:
    """Sequential minimal optimisation.  Rows are visited in turn; the partner
    of a violating row is the one whose error differs most."""
    n = len(y)
    alpha, b = np.zeros(n), 0.0
    error = -y.astype(float)
    still = visits = 0
    while still < quiet and visits < most:
        changed = False
        for i in range(n):
            visits += 1
            r = y[i] * error[i]
            if not (r < -tolerance and alpha[i] < bound[i] or r > tolerance and alpha[i] > 0):
                continue
            gap = np.abs(error - error[i])
            gap[i] = -1
            j = int(gap.argmax())
            if j == i:
                continue
            same = y[i] == y[j]
            low = max(0.0, alpha[i] + alpha[j] - bound[i] if same else alpha[j] - alpha[i])
            high = min(bound[j], alpha[i] + alpha[j] if same else bound[i] + alpha[j] - alpha[i])
            curve = 2 * kernel[i, j] - kernel[i, i] - kernel[j, j]
            if low >= high or curve >= 0:
                continue
            new_j = min(high, max(low, alpha[j] - y[j] * (error[i] - error[j]) / curve))
            step_j = new_j - alpha[j]
            if abs(step_j) < 1e-7:
                continue
            step_i = -y[i] * y[j] * step_j
            alpha[i] += step_i
            alpha[j] = new_j
            shift_i = -error[i] - y[i] * step_i * kernel[i, i] - y[j] * step_j * kernel[i, j]
            shift_j = -error[j] - y[i] * step_i * kernel[i, j] - y[j] * step_j * kernel[j, j]
            shift = shift_i if 0 < alpha[i] < bound[i] else shift_j if 0 < alpha[j] < bound[j] else (shift_i + shift_j) / 2
            error += y[i] * step_i * kernel[i] + y[j] * step_j * kernel[j] + shift
            b += shift
            changed = True
        still = 0 if changed else still + 1
    return alpha, b


def fit_plain(x: np.ndarray, y: np.ndarray, gamma: float, cost: float) -> Svm:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale == 0, 1.0, scale)
    z = (x - mean) / scale
    pos = max(1, int((y > 0).sum()))
    neg = max(1, int((y < 0).sum()))
    bound = cost * np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg))
    d = (z**2).sum(1)[:, None] + (z**2).sum(1)[None, :] - 2 * z @ z.T
    alpha, b = solve(np.exp(-gamma * np.maximum(d, 0)), y, bound)
    keep = alpha > 1e-8
    return Svm(mean, scale, gamma, float(b), (alpha * y)[keep], z[keep])


def folds_of(y: np.ndarray, k: int) -> np.ndarray:
    """Fold of each row, dealt out in turn within each class."""
    out = np.zeros(len(y), int)
    for side in (y > 0, y <= 0):
        out[side] = np.arange(side.sum()) % k
    return out


def calibrate(f: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve through decisions, with smoothed
    targets, by Newton steps."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([0.0, math.log((pos + 1) / (neg + 1))])
    design = np.stack([f, np.ones(len(f))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -700, 700)))
        slope = design.T @ (p - target)
        if np.abs(slope).max() < 1e-6:
            break
        hess = (design * (p * (1 - p))[:, None]).T @ design
        if abs(np.linalg.det(hess)) < 1e-12:
            break
        w = w - np.linalg.solve(hess, slope)
    return float(w[0]), float(w[1])


@dataclass(frozen=True)
class Report:
    roc: float | None
    pr: float | None
    folds: int
    positives: int
    negatives: int
    warning: str | None


def fit_svm(x: np.ndarray, y: np.ndarray, gamma: float | None = None, cost: float = 2.0, folds: int = 5) -> tuple[Svm, Report]:
    """Fit with stratified cross-validation; the scaler is fitted in each fold."""
    x, y = np.asarray(x, float), np.asarray(y)
    if not len(x) or len(x) != len(y):
        raise ValueError("rows and labels must be as many, and some")
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    if not pos or not neg:
        raise ValueError("faulty and clean examples are both needed")
    gamma = gamma or 1 / x.shape[1]
    k = max(2, min(folds, pos, neg))
    fold, held = folds_of(y, k), np.zeros(len(y))
    for f in range(k):
        train = fold != f
        if len(set((y[train] > 0).tolist())) == 2:
            held[~train] = fit_plain(x[train], y[train], gamma, cost).decision(x[~train])
    model = fit_plain(x, y, gamma, cost)
    model = replace(model, platt=calibrate(model.decision(x), y))
    warning = f"{pos} faulty examples; under {MIN_POSITIVES} the cross-validated score is noise" if pos < MIN_POSITIVES else None
    return model, Report(roc_auc(held, y), average_precision(held, y), k, pos, neg, warning)


def svm_scores(df: DataFrame, model: Svm, vec_col: str) -> DataFrame:
    """Adds decision and probability; vectors of another length are an error."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame[vec_col].to_numpy()).astype(float)
            if x.shape[1] != m.dim:
                raise ValueError(f"vectors have {x.shape[1]} dimensions, the model {m.dim}")
            yield frame.assign(decision=m.decision(x), probability=m.probability(x))

    return df.mapInPandas(run, schema_with(df, decision=T.DoubleType(), probability=T.DoubleType()))


def dumps(model: Svm, **about: object) -> str:
    """Self-describing JSON with provenance."""
    arrays = {k: getattr(model, k).tolist() for k in ("mean", "scale", "dual")}
    body = {"format": FORMAT, "version": VERSION, "dim": model.dim, "n_sv": len(model.dual), "gamma": model.gamma, "intercept": model.intercept, "threshold": model.threshold, "platt": model.platt, **arrays, "vectors": model.vectors.ravel().tolist()}
    return json.dumps(body | {"about": about})


def loads(text: str, dim: int | None = None) -> tuple[Svm, dict]:
    """Read a model; a wrong format, version, length or number is refused."""
    body = json.loads(text)
    if not isinstance(body, dict) or body.get("format") != FORMAT:
        raise ValueError("this is no classifier file")
    if body.get("version") != VERSION:
        raise ValueError(f"version {body.get('version')} is not known")
    d, n = body.get("dim"), body.get("n_sv")
    if dim is not None and d != dim:
        raise ValueError(f"the model is for {d} dimensions, not {dim}")
    want = {"mean": d, "scale": d, "dual": n, "vectors": d * n}
    arrays = {}
    for name, length in want.items():
        arrays[name] = np.asarray(body.get(name, []), float)
        if arrays[name].shape != (length,) or not np.isfinite(arrays[name]).all():
            raise ValueError(f"{name} should have {length} finite numbers")
    if not all(isinstance(body.get(k), (int, float)) and math.isfinite(body[k]) for k in ("gamma", "intercept", "threshold")):
        raise ValueError("gamma, intercept and threshold should be finite numbers")
    platt = tuple(map(float, body["platt"])) if body.get("platt") else None
    return Svm(arrays["mean"], arrays["scale"], body["gamma"], body["intercept"], arrays["dual"], arrays["vectors"].reshape(n, d), body["threshold"], platt), body.get("about", {})
