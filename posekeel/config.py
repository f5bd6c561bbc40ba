"""Quality-control settings.  Thresholds enter plans as literals, so changing
one never refits a model; only the baseline source and reference size do."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, fields, replace

#: fixed values: the checks and whether they are on at first
CHECKS = {
    "anomaly": True, "gmm": True, "chirality": True, "ordering": False, "poseSplit": True, "count": False, "sparse": False,
    "confidence": False, "instConfidence": False, "negative": False, "outOfFrame": True, "duplicates": True, "appearance": False,
    "nodeAppearance": False, "bundleAppearance": False,
}
#: fixed values: severity of frame-level checks in the review queue
SEVERITY = {"count": 0.9, "sparse": 0.85, "outOfFrame": 0.7, "instConfidence": 0.62, "confidence": 0.6, "negative": 0.45, "duplicates": 0.4}

FEATURES = (
    "max_edge_zscore", "mean_edge_zscore", "max_angle_zscore", "mean_angle_zscore", "max_pairwise_zscore", "mean_pairwise_zscore",
    "bbox_area_zscore", "max_centroid_distance", "centroid_distance_std", "min_symmetry_consistency", "visibility_rate",
    "has_isolated_invisible", "max_curvature", "curvature_std", "visibility_pattern_score", "nn_distance", "hull_area_zscore",
    "hull_compactness",
)


@dataclass(frozen=True)
class FeatureCheck:
    feature: str
    threshold: float = 3.0
    on: bool = True


@dataclass(frozen=True)
class QCConfig:
    threshold: float = 0.7
    gmm_threshold: float = 0.95
    chirality_threshold: float = 0.5
    ordering_threshold: float = 0.3
    pose_split_threshold: float = 0.9
    sparse_fraction: float = 0.5
    confidence_threshold: float = 0.3
    confidence_mode: str = "avg"
    inst_confidence_threshold: float = 0.3
    baseline_source: str = "all"
    review_order: str = "severity"
    out_of_frame_margin: float = 0.0
    duplicate_iou: float = 0.5
    duplicate_distance: float = 10.0
    duplicate_ratio: float = 0.8
    max_reference: int = 4000
    gmm_components: int = 5
    gmm_min_samples: int = 50
    use_curvature: bool | None = None
    ordered_chains: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, bool] = field(default_factory=lambda: dict(CHECKS))
    feature_checks: tuple[FeatureCheck, ...] = ()

    def curvature_on(self, longest_chain: int) -> bool:
        """Curvature needs a spine of five nodes, unless it is set."""
        return longest_chain >= 5 if self.use_curvature is None else self.use_curvature

    def with_check(self, name: str, on: bool) -> QCConfig:
        if name not in CHECKS:
            raise KeyError(name)
        return replace(self, checks={**self.checks, name: on})

    def with_feature_check(self, feature: str, threshold: float = 3.0, on: bool = True) -> QCConfig:
        """Add or replace the one check of a feature."""
        rest = tuple(c for c in self.feature_checks if c.feature != feature)
        return replace(self, feature_checks=(*rest, FeatureCheck(feature, threshold, on)))

    def needs_refit(self, other: QCConfig) -> bool:
        return (self.baseline_source, self.max_reference) != (other.baseline_source, other.max_reference)

    def dumps(self) -> str:
        return json.dumps(asdict(self))


CHOICES = {"confidence_mode": ("avg", "min"), "baseline_source": ("all", "user"), "review_order": ("severity", "detectors", "frame")}


def merge_config(saved: object, base: QCConfig | None = None) -> tuple[QCConfig, list[str], list[str]]:
    """Take over what has the right shape from saved settings, key by key.
    Returns the settings, the names restored and the names dropped."""
    config = base or QCConfig()
    if not isinstance(saved, dict):
        return config, [], []
    known = {f.name: getattr(config, f.name) for f in fields(config)}
    new, restored, dropped = {}, [], []
    for name, value in saved.items():
        have = known.get(name)
        if name == "checks" and isinstance(value, dict):
            good = {k: v for k, v in value.items() if k in CHECKS and isinstance(v, bool)}
            new[name] = {**config.checks, **good}
            restored += [f"checks.{k}" for k in good]
            dropped += [f"checks.{k}" for k in value if k not in good]
        elif name == "feature_checks" and isinstance(value, (list, tuple)):
            seen: dict[str, FeatureCheck] = {}
            for i, x in enumerate(value):
                if isinstance(x, dict) and isinstance(x.get("feature"), str) and _number(x.get("threshold", 3.0)) and isinstance(x.get("on", True), bool) and x["feature"] not in seen:
                    seen[x["feature"]] = FeatureCheck(x["feature"], float(x.get("threshold", 3.0)), x.get("on", True))
                else:
                    dropped.append(f"feature_checks.{i}")
            new[name] = tuple(seen.values())
            restored.append(name)
        elif name == "ordered_chains" and isinstance(value, (list, tuple)):
            new[name] = tuple(tuple(map(str, c)) for c in value if isinstance(c, (list, tuple)))
            restored.append(name)
        elif name in CHOICES and value in CHOICES[name] or name in known and isinstance(have, (int, float)) and not isinstance(have, bool) and _number(value):
            new[name] = type(have)(value)
            restored.append(name)
        else:
            dropped.append(name)
    return replace(config, **new), restored, dropped


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
