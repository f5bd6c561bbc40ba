"""Z-score anomaly and checks on single features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posekeel.functions.columns import clean, sigmoid

FLOOR = 1e-6


def fit_zscore(rows: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each feature over rows that have all of them."""
    whole = rows.dropna(subset=list(features))
    got = whole.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    return {f: (got[f"m{i}"] or 0.0, max(got[f"s{i}"] or 0.0, FLOOR)) for i, f in enumerate(features)}


def add_zscores(rows: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """z_<feature> of the raw values, null where the feature is."""
    return rows.withColumns({f"z_{f}": F.abs((F.col(f) - m) / s) for f, (m, s) in fitted.items()})


def anomaly_score(rows: DataFrame, fitted: dict[str, tuple[float, float]], centre: float = 3.0) -> DataFrame:
    """Adds anomaly: the logistic of the largest |z| of the cleaned features."""
    zs = [F.abs((clean(F.col(f)) - m) / s) for f, (m, s) in fitted.items()]
    largest = F.greatest(*zs) if len(zs) > 1 else zs[0]
    return rows.withColumn("anomaly", F.coalesce(F.nanvl(sigmoid(largest - centre), F.lit(None).cast("double")), F.lit(0.0)))


def feature_check(rows: DataFrame, fitted: dict[str, tuple[float, float]], feature: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose |z| of one feature reaches the threshold; a feature that was
    not fitted never fires."""
    if feature not in fitted:
        return rows.where("false")
    m, s = fitted[feature]
    return rows.withColumn("z", F.abs((F.col(feature) - m) / s)).where(F.col("z") >= threshold)
