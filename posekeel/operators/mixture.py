"""Gaussian mixture outliers: fitted on the driver over the capped reference,
scored in Arrow batches by rank among the training likelihoods."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from posekeel.functions.columns import schema_with
from posekeel.functions.numeric import seeded_uniforms

LOG_2PI = float(np.log(2 * np.pi))


def scaler(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Population mean and deviation; a constant column scales by one."""
    spread = x.std(0)
    return x.mean(0), np.where(spread <= 1e-12, 1.0, spread)


def lower_root(a: np.ndarray) -> np.ndarray:
    """Cholesky factor; a pivot that is not positive counts as 1e-12."""
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        n = len(a)
        out = np.zeros((n, n))
        for i in range(n):
            out[i, i] = np.sqrt(max(a[i, i] - out[i, :i] @ out[i, :i], 1e-12))
            out[i + 1 :, i] = (a[i + 1 :, i] - out[i + 1 :, :i] @ out[i, :i]) / out[i, i]
        return out


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def __post_init__(self) -> None:
        self.roots = np.stack([lower_root(c) for c in self.covariances])

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Log weight plus log density of each row in each component."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m, root) in enumerate(zip(self.weights, self.means, self.roots)):
            z = np.linalg.solve(root, (x - m).T)
            with np.errstate(divide="ignore"):
                out[:, k] = np.log(w) - 0.5 * (len(m) * LOG_2PI + 2 * np.log(np.diag(root)).sum() + (z**2).sum(0))
        return out

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        return self.added(self.log_parts(x))

    @staticmethod
    def added(parts: np.ndarray) -> np.ndarray:
        """Log of the sum over components."""
        top = parts.max(1)
        return top + np.log(np.exp(parts - np.where(np.isfinite(top), top, 0)[:, None]).sum(1))


def maximise(x: np.ndarray, share: np.ndarray, floor: float) -> Mixture:
    size = share.sum(0)
    safe = np.where(size == 0, 1.0, size)
    means = share.T @ x / safe[:, None]
    covariances = []
    for k in range(share.shape[1]):
        d = x - means[k]
        covariances.append((share[:, k, None] * d).T @ d / safe[k] + floor * np.eye(x.shape[1]))
    return Mixture(size / len(x), means, np.stack(covariances))


def spread_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Seeded centres, each chosen by squared distance to those before."""
    draw = seeded_uniforms(seed)
    chosen = [int(next(draw) * len(x))]
    while len(chosen) < k:
        d = ((x[:, None, :] - x[chosen][None]) ** 2).sum(2).min(1)
        mark = next(draw) * (d.sum() or 1.0)
        chosen.append(min(int(np.searchsorted(np.cumsum(d), mark, "left")), len(x) - 1))
    return x[chosen]


def fit_mixture(x: np.ndarray, k: int, floor: float = 1e-6, rounds: int = 100, tolerance: float = 1e-3, seed: int = 42) -> Mixture:
    centres = spread_centres(x, k, seed)
    nearest = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
    model = maximise(x, np.eye(k)[nearest], floor)
    before = -np.inf
    for _ in range(rounds):
        parts = model.log_parts(x)
        norm = model.log_likelihood(x)
        model = maximise(x, np.exp(parts - norm[:, None]), floor)
        if abs(norm.mean() - before) < tolerance:
            break
        before = norm.mean()
    return model


@dataclass
class Outliers:
    """A fitted mixture with its scaler and sorted training likelihoods."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    mixture: Mixture
    likelihoods: np.ndarray
    n_train: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """One minus the share of training rows that are less likely."""
        return self._rank(self.mixture.log_likelihood((x - self.mean) / self.scale))

    def _rank(self, ll: np.ndarray) -> np.ndarray:
        out = 1 - np.searchsorted(self.likelihoods, ll, "left") / self.n_train
        return np.where(np.isfinite(ll), out, 1.0)

    def blame(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contribution of each feature to the Mahalanobis distance from the
        most responsible component, and the feature with the largest."""
        z = (x - self.mean) / self.scale
        return self._blame(z, self.mixture.log_parts(z))

    def _blame(self, z: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, parts = logs.argmax(1), np.empty_like(z)
        for k, root in enumerate(self.mixture.roots):
            rows = np.flatnonzero(best == k)
            d = z[rows] - self.mixture.means[k]
            parts[rows] = d * (d @ np.linalg.inv(root @ root.T).T)
        return parts, parts.argmax(1)

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and the features to blame, from densities taken once."""
        z = (x - self.mean) / self.scale
        logs = self.mixture.log_parts(z)
        return self._rank(self.mixture.added(logs)), self._blame(z, logs)[1]


def fit_outliers(x: np.ndarray, features: Sequence[str], components: int = 5) -> Outliers:
    """Fit on rows without missing values; at least two are needed."""
    x = x[~np.isnan(x).any(1)]
    if len(x) < 2:
        raise ValueError("at least two complete rows are needed for a mixture")
    mean, scale = scaler(x)
    z = (x - mean) / scale
    model = fit_mixture(z, max(1, min(components, len(x) // 10)))
    ll = model.log_likelihood(z)
    return Outliers(tuple(features), mean, scale, model, np.sort(ll[np.isfinite(ll)]), len(x))


def gmm_scores(rows: DataFrame, model: Outliers) -> DataFrame:
    """Adds gmm (score, 0 if not finite) and gmm_feature (the worst)."""
    names = list(model.features)
    spark_model = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = spark_model.value
        for frame in frames:
            x = np.nan_to_num(frame[names].to_numpy(float), nan=0.0, posinf=10.0, neginf=-10.0)
            if len(x):
                score, worst = m.judge(x)
                yield frame.assign(gmm=np.nan_to_num(score), gmm_feature=np.array(names, object)[worst])

    return rows.mapInPandas(run, schema_with(rows, gmm=T.DoubleType(), gmm_feature=T.StringType()))


def leave_one_node_out(model: Outliers, rows: np.ndarray, without: np.ndarray) -> np.ndarray:
    """Node whose removal makes a pose most likely: ``without[i, j]`` are the
    features of pose i scored without node j.  -1 if none improves it."""
    n, k, d = without.shape
    gain = model.mixture.log_likelihood((without.reshape(n * k, d) - model.mean) / model.scale).reshape(n, k)
    base = model.mixture.log_likelihood((rows - model.mean) / model.scale)
    best = gain.argmax(1)
    return np.where(gain[np.arange(n), best] > base, best, -1)
