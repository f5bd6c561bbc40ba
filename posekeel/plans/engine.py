"""A whole run: only the units that enabled checks need are planned."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posekeel.config import FEATURES, QCConfig
from posekeel.functions import geometry as g
from posekeel.operators import features, flags, frame_checks, mixture, structure, zscore
from posekeel.plans.pose_view import FRAME, KEY, Project


@dataclass
class Run:
    """Fits are made once, when first needed; thresholds never refit."""

    project: Project
    config: QCConfig = QCConfig()
    #: key and appearance (a robust z), from an appearance check of embeddings
    appearance: DataFrame | None = None
    appearance_threshold: float = 3.0

    @cached_property
    def fitted(self) -> features.Fitted:
        return features.fit_features(self.project, self.config)

    @cached_property
    def reference_features(self) -> DataFrame:
        rows = features.reference_rows(self.project.instances, self.config.max_reference, self.config.baseline_source)
        part = Project(self.project.videos, self.project.frames, rows, self.project.skeleton)
        return features.feature_table(part, self.fitted, self.config).persist()

    @cached_property
    def zscore_fit(self) -> dict[str, tuple[float, float]]:
        return zscore.fit_zscore(self.reference_features, FEATURES)

    @cached_property
    def mixture_fit(self) -> mixture.Outliers | None:
        x = self.reference_features.orderBy(*KEY).select(*FEATURES).toPandas().to_numpy(float)
        return mixture.fit_outliers(x, FEATURES, self.config.gmm_components) if (~np.isnan(x).any(1)).sum() >= 2 else None

    def on(self, check: str) -> bool:
        return self.config.checks.get(check, False)

    @cached_property
    def scores(self) -> DataFrame:
        """Key, features and the score of every enabled detector, in one pass
        over the poses: no join, and nothing is held."""
        s, p, more, extra = self.project.skeleton, self.project, [], []
        if self.on("chirality"):
            more.append(structure.chirality_step(structure.fit_chirality(p.instances, s), s.n_nodes))
            extra += ["chirality", "chirality_node"]
        if self.on("poseSplit"):
            more.append(structure.split_step(s, self.fitted.stats))
            extra += ["pose_split", "bridge_a", "bridge_b"]
        if self.on("ordering"):
            found = ["order_inversion_rate", "chain_intersection_count", "ordering_score"]
            poses = g.add_layers(g.add_layers(p.instances, [g.measures(s)[0]]), g.ordering(s.ordered_chains(self.config.ordered_chains)))
            p = replace(p, instances=poses.select(*p.instances.columns, *found))
            extra += found
        out = features.feature_table(p, self.fitted, self.config, more=more, keep=extra)
        if self.on("anomaly") or self.config.feature_checks:
            out = zscore.anomaly_score(out, self.zscore_fit)
        if self.on("gmm") and self.mixture_fit:
            out = mixture.gmm_scores(out, self.mixture_fit)
        return out.select(*[c for c in out.columns if c not in extra], *extra)

    @cached_property
    def instance_scores(self) -> DataFrame:
        """The scores, held for those who read them more than once, and as
        filters must not be pushed down and written out over the layers of the
        geometry."""
        return self.scores.persist()

    def close(self) -> None:
        """Give up what is held; later reads would make it anew."""
        for name in ("reference_features", "instance_scores"):
            held = self.__dict__.pop(name, None)
            if held is not None:
                held.unpersist()

    @cached_property
    def limits(self) -> dict[str, float]:
        c = self.config
        every = {"anomaly": ("anomaly", c.threshold), "gmm": ("gmm", c.gmm_threshold), "chirality": ("chirality", c.chirality_threshold), "ordering": ("ordering_score", c.ordering_threshold), "poseSplit": ("pose_split", c.pose_split_threshold)}
        return {column: limit for check, (column, limit) in every.items() if self.on(check) and column in self.scores.columns}

    @cached_property
    def frames(self) -> DataFrame:
        """Frame checks, largest scores, flags and their union."""
        names = {"count": "is_wrong_count", "sparse": "is_sparse", "confidence": "is_low_confidence", "instConfidence": "is_low_inst_confidence", "negative": "is_negative_with_instances", "duplicates": "has_duplicates", "outOfFrame": "is_out_of_frame"}
        checked = frame_checks.frame_checks(self.project, self.config)
        if self.limits:  # else no check needs a feature
            several = self.config.feature_checks or "instance_scores" in self.__dict__
            checked = checked.join(flags.rollup_max(self.instance_scores if several else self.scores, list(self.limits)), list(FRAME), "left")
        joined = checked.withColumns({f"flag_{k}": F.col(c) & F.lit(self.on(k)) for k, c in names.items()})
        flagged = flags.flag_columns(joined, self.limits)
        for check in self.config.feature_checks:
            if check.on and check.feature in FEATURES:
                hits = zscore.feature_check(self.instance_scores, self.zscore_fit, check.feature, check.threshold).select(*FRAME).distinct().withColumn(f"flag_{check.feature}", F.lit(True))
                flagged = flagged.join(hits, list(FRAME), "left").fillna(False, [f"flag_{check.feature}"])
        if self.appearance is not None:
            worst = flags.rollup_max(self.appearance, ["appearance"])
            odd = F.coalesce(F.col("appearance") >= self.appearance_threshold, F.lit(False))
            flagged = flagged.join(worst, list(FRAME), "left").withColumn("flag_appearance", odd)
        return flagged.withColumn("frame_flagged", flags.any_of([c for c in flagged.columns if c.startswith("flag_")]))
