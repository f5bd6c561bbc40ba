"""Scoring edited instances against frozen fits, in batch or as a stream.

Nothing is refitted: fitted statistics are literals of the plan, so a micro
batch is one stage over the edited rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from posekeel.config import FEATURES, QCConfig
from posekeel.operators.features import Fitted, feature_table
from posekeel.operators.zscore import anomaly_score
from posekeel.plans.pose_view import FRAME, KEY, Project


def rescore(edited: DataFrame, project: Project, fitted: Fitted, zscore: dict[str, tuple[float, float]], config: QCConfig = QCConfig()) -> DataFrame:
    """Key and anomaly of edited instances; distances are full ones, so an
    instance of the reference may find itself."""
    part = Project(project.videos, project.frames, edited, project.skeleton)
    table = feature_table(part, fitted, config, leave_one_out=False)
    return anomaly_score(table, {f: zscore[f] for f in FEATURES}).select(*KEY, "anomaly")


def upsert(scores: DataFrame, changes: DataFrame) -> DataFrame:
    """Scores with those of changed keys replaced or added."""
    kept = scores.join(changes.select(*KEY), list(KEY), "left_anti")
    return kept.unionByName(changes)


def frame_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*FRAME).agg(F.max("anomaly").alias("anomaly"))


def stream_rescore(edits: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Score a stream of edited instances and append them by batch: a replayed
    batch overwrites its own folder, so results are exactly once."""
    def sink(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in KEY]), "seq").alias("e")).select(*KEY, "e.*")
        score(latest.drop("seq")).withColumn("revision", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = edits.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_scores(results: DataFrame) -> DataFrame:
    """Newest revision of each instance."""
    return results.groupBy(*KEY).agg(F.max_by("anomaly", "revision").alias("anomaly"), F.max("revision").alias("revision"))
