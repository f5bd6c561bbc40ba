"""Keypoint labels: a log of verdicts, the latest of each instance counts.
A reviewed instance without a bad node is a negative example."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posekeel.plans.pose_view import KEY


def fold_log(log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Latest verdict of each instance from rows (keys, seq, reviewed, bad); an
    unreview takes it out."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct("reviewed", "bad"), "seq").alias("v"))
    return last.where("v.reviewed").select(*keys, F.array_sort(F.array_distinct(F.coalesce("v.bad", F.array().cast("array<string>")))).alias("bad"))


def merge_labels(*tables: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Union of the bad nodes of each reviewed instance over all tables."""
    every = tables[0].select(*keys, "bad")
    for t in tables[1:]:
        every = every.unionByName(t.select(*keys, "bad"))
    return every.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bad")))).alias("bad"))


def tally(labels: DataFrame) -> DataFrame:
    """How often each node was called bad, most first."""
    return labels.select(F.explode("bad").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node")


def training_rows(embeddings: DataFrame, labels: DataFrame, node: str = "node") -> DataFrame:
    """Embedding rows of reviewed instances with y = 1 (bad) or -1; others are
    left out, as nobody looked at them."""
    return embeddings.join(labels, list(KEY)).withColumn("y", F.when(F.array_contains("bad", F.col(node)), 1).otherwise(-1)).drop("bad")
