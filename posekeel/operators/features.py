"""The eighteen features of an instance and the models behind them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posekeel.config import FEATURES, QCConfig
from posekeel.functions import geometry as g
from posekeel.functions.columns import Step, clean, schema_with, stepped
from posekeel.functions.numeric import hull_batch, normalised_pose
from posekeel.plans.pose_view import KEY, Project
from posekeel.skeleton import Skeleton


def literal(values: dict[str, float]) -> g.Stat:
    """Fitted values as SQL literals: bounded by the skeleton, not the data."""
    return lambda name: f"CAST('{float(values[name])!r}' AS DOUBLE)"


@dataclass(frozen=True)
class Fitted:
    """Learned statistics; ``reference`` is the capped set of normalised poses."""

    stats: dict[str, float]
    reference: np.ndarray
    reference_keys: frozenset


def reference_rows(instances: DataFrame, cap: int, source: str = "all") -> DataFrame:
    """The fit rows: all, or those annotated by a user (no instance score) if
    there are any; above ``cap`` every (n / cap)-th in key order.

    Rows are numbered without a global window: counts by (video, frame) block
    are few, and only they are summed up in order.  Only keys are shuffled."""
    eligible = instances.where("inst_score is null") if source == "user" else instances
    if source == "user" and eligible.isEmpty():
        eligible = instances
    n = eligible.count()
    if n <= cap:
        return eligible
    blocks = eligible.groupBy("video_idx", F.floor(F.col("frame_idx") / 1024).alias("_block")).agg(F.count(F.lit(1)).alias("_c"))
    before = blocks.withColumn("_before", F.sum("_c").over(Window.orderBy("video_idx", "_block").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("video_idx", "_block").orderBy("frame_idx", "inst_idx")) - 1
    numbered = (
        eligible.select(*KEY).withColumn("_block", F.floor(F.col("frame_idx") / 1024)).withColumn("_in", inside)
        .join(before.select("video_idx", "_block", "_before"), ["video_idx", "_block"]).withColumn("_no", F.col("_in") + F.coalesce("_before", F.lit(0)))
    )
    # row number i is taken if some k has floor(k * n / cap) = i
    k = F.ceil(F.col("_no") * F.lit(cap) / F.lit(n))
    taken = numbered.where((F.floor(k * F.lit(n) / F.lit(cap)) == F.col("_no")) & (k < cap)).select(*KEY)
    return eligible.join(F.broadcast(taken), list(KEY), "left_semi")  # at most ``cap`` keys


def pose_array(frame: pd.DataFrame, n: int) -> np.ndarray:
    cols = [f"{a}{k}" for k in range(n) for a in "xy"]
    return frame[cols].to_numpy(float).reshape(len(frame), n, 2)


def hull_columns(instances: DataFrame, n: int) -> DataFrame:
    """Adds hull_area and hull_compactness, a batch of poses at a time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            area, compactness = hull_batch(pose_array(frame, n))
            yield frame.assign(hull_area=area, hull_compactness=compactness)

    schema = schema_with(instances, hull_area=T.DoubleType(), hull_compactness=T.DoubleType())
    return instances.mapInPandas(run, schema)


def fit_features(project: Project, config: QCConfig = QCConfig()) -> Fitted:
    """Statistics and reference in two passes over the capped fit rows."""
    s = project.skeleton
    rows = reference_rows(project.instances, config.max_reference, config.baseline_source).cache()
    measured = g.add_layers(rows, g.measures(s))
    names = g.measure_names(s)
    first = measured.selectExpr(*g.fit_aggregates(names), *g.co_visibility(s)).first().asDict()
    areas = hull_columns(rows, s.n_nodes).where("hull_area > 0").agg(F.coalesce(F.avg("hull_area"), F.lit(1.0)).alias("m"), F.coalesce(F.stddev_pop("hull_area"), F.lit(1.0)).alias("s")).first()
    local = rows.orderBy(*KEY).toPandas()  # at most max_reference rows
    rows.unpersist()
    poses = np.nan_to_num(normalised_pose(pose_array(local, s.n_nodes)).reshape(len(local), -1))
    keys = frozenset(zip(local["video_idx"], local["frame_idx"], local["inst_idx"]))
    return Fitted({**first, "m_hull_area": areas["m"], "s_hull_area": max(areas["s"], 1e-6)}, poses, keys)


def nearest_distance(query: np.ndarray, reference: np.ndarray, block: int = 64, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each row to its two nearest reference rows; the second only
    where ``second`` is set, if it is given."""
    one, two = np.full(len(query), np.inf), np.full(len(query), np.inf)
    if not len(reference):
        return one, two
    # the product alone gives squared distances less the row's own square, which
    # leaves their order; distances are then taken from differences
    ways = np.vstack([-2 * reference.T, (reference**2).sum(1)])
    rows = np.hstack([query, np.ones((len(query), 1))])
    away = lambda q, k: np.sqrt(((q - reference[k]) ** 2).sum(1))
    for at in range(0, len(query), block):
        part = slice(at, at + block)
        d = rows[part] @ ways
        near = d.argmin(1)
        one[part] = away(query[part], near)
        more = np.arange(len(d)) if second is None else np.flatnonzero(second[part])
        if len(more) and len(reference) > 1:
            d[more, near[more]] = np.inf
            two[at + more] = away(query[at + more], d[more].argmin(1))
    return one, two


def shape_columns(instances: DataFrame, fitted: Fitted, n: int, leave_one_out: bool = True, more: Sequence[Step] = ()) -> DataFrame:
    """Adds nn_distance, hull_area and hull_compactness, then what ``more``
    adds.  A fit row is compared with the others (0 if there is none), unless
    full distances are asked for."""
    reference, keys = fitted.reference, fitted.reference_keys

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            xy = pose_array(frame, n)
            own = np.array([leave_one_out and k in keys for k in zip(frame["video_idx"].tolist(), frame["frame_idx"].tolist(), frame["inst_idx"].tolist())], bool)
            one, two = nearest_distance(np.nan_to_num(normalised_pose(xy).reshape(len(xy), -1)), reference, second=own)
            nn = np.where(own, np.where(np.isfinite(two), two, 0.0), one)
            area, compactness = hull_batch(xy)
            yield frame.assign(nn_distance=nn, hull_area=area, hull_compactness=compactness)

    return stepped(instances, (run, {c: T.DoubleType() for c in ("nn_distance", "hull_area", "hull_compactness")}), *more)


def baseline(instances: DataFrame, s: Skeleton, stats: dict[str, float]) -> DataFrame:
    """Features 1 to 12 by generated expressions only."""
    return g.add_layers(g.add_layers(instances, g.measures(s)), g.baseline_features(s, literal(stats)))


def feature_table(
    project: Project, fitted: Fitted, config: QCConfig = QCConfig(), leave_one_out: bool = True, more: Sequence[Step] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Key, inst_score and the eighteen features of every instance, then the
    columns of ``keep``; those of ``more`` are made beside the features."""
    s = project.skeleton
    shaped = shape_columns(project.instances, fitted, s.n_nodes, leave_one_out, more)
    based = baseline(shaped, s, fitted.stats)
    chains = s.curvature_chains()
    if config.curvature_on(len(s.spine)) and chains:
        based = g.add_layers(based, g.curvature(chains[0]))
    else:
        based = g.add_layers(based, [{"max_curvature": "CAST(0.0 AS DOUBLE)", "curvature_std": "CAST(0.0 AS DOUBLE)"}])
    based = g.add_layers(based, [g.visibility_pattern(s, literal(fitted.stats))])
    hull = (F.col("hull_area") - fitted.stats["m_hull_area"]) / fitted.stats["s_hull_area"]
    return based.withColumn("hull_area_zscore", hull).select(*KEY, "inst_score", *FEATURES, *keep)


def clean_features(table: DataFrame) -> DataFrame:
    """Feature values as detectors score them."""
    return table.withColumns({f: clean(F.col(f)) for f in FEATURES})
