"""Result tables in the form other tools read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posekeel.config import FEATURES
from posekeel.operators.explain import confidence_word, top_issue
from posekeel.plans.pose_view import KEY


def number_text(x: Column) -> Column:
    """A number as text: whole ones with .0, missing and not finite ones 0.0."""
    v = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double"))
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), F.concat(v.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(v.cast("string"))


def truth_text(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), "True").otherwise("False")


def qc_results(rows: DataFrame, frame_flags: DataFrame, min_samples: int = 50) -> DataFrame:
    """The 27 columns of the results export, typed.  The score is the mixture's
    if it ran on at least ``min_samples`` instances, else the z-score's.  Both
    ordering columns are 0 where that check did not run."""
    n = rows.where("gmm is not null").limit(min_samples).count() if "gmm" in rows.columns else 0
    score = F.coalesce("gmm", F.lit(0.0)) if n >= min_samples else F.col("anomaly")
    order = [(F.col(c).cast("double") if c in rows.columns else F.lit(0.0)).alias(c) for c in ("order_inversion_rate", "chain_intersection_count")]
    joined = top_issue(rows, FEATURES).join(frame_flags.select("video_idx", "frame_idx", "frame_flagged"), ["video_idx", "frame_idx"], "left")
    return joined.select(
        *KEY, score.alias("score"), confidence_word(score).alias("confidence"), "top_issue", *FEATURES,
        *order, F.coalesce("frame_flagged", F.lit(False)).alias("frame_flagged"),
    )


def as_text(table: DataFrame) -> DataFrame:
    """Numbers and truth values in the export's notation."""
    cols = []
    for f in table.schema:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        cols.append((number_text(c) if kind == "double" else truth_text(c) if kind == "boolean" else c.cast("string")).alias(f.name))
    return table.select(*cols)


def write_csv(table: DataFrame, path: str) -> None:
    as_text(table).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def keypoint_label_rows(labels: DataFrame) -> DataFrame:
    """frame_index, frame_idx, video, instance, n_bad_keypoints, bad_keypoints
    in key order.  Rows are numbered by video blocks, not in one task."""
    counts = labels.groupBy("video_idx").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("video_idx", F.coalesce(F.sum("_c").over(Window.orderBy("video_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("video_idx").orderBy("frame_idx", "inst_idx")) - 1
    numbered = labels.withColumn("_i", inside).join(before, "video_idx")
    return numbered.select(
        (F.col("_b") + F.col("_i")).alias("frame_index"), "frame_idx", F.col("video_idx").alias("video"), F.col("inst_idx").alias("instance"),
        F.size("bad").alias("n_bad_keypoints"), F.array_join("bad", ";").alias("bad_keypoints"),
    ).orderBy("frame_index")


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """Cache of embeddings by file; a job that fails leaves whole files only."""
    embeddings.write.mode("append").partitionBy("file_id").parquet(path)
