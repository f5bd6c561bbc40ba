"""CSV files of human reviews and keypoint labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: words that count as a faulty verdict, and column aliases
FAULTY = ("faulty", "bad", "1", "true", "yes")
ALIASES = {"frame_idx": ("frame_idx", "frame"), "video": ("video", "video_idx"), "status": ("status", "verdict"), "notes": ("notes", "note"), "instance": ("instance", "inst")}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; byte-order mark and quotes are handled."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip("\ufeff").strip().lower() for c in df.columns])


def _column(df: DataFrame, name: str) -> Column | None:
    return next((F.col(a) for a in ALIASES.get(name, (name,)) if a in df.columns), None)


def bad_nodes(text: Column) -> Column:
    """Semicolon-separated node names, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def parse_review(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(video_idx, frame_idx, faulty, notes), one row per frame, and whether
    the file lists faulty frames only.  Rows of a frame are joined: faulty if
    one is, notes strung together in file order."""
    status, instance = _column(rows, "status"), _column(rows, "instance")
    faulty_only = status is None
    verdict = F.lit(True) if faulty_only else F.lower(F.trim(status)).isin(*FAULTY)
    if not faulty_only and "n_faulty" in rows.columns:
        verdict = verdict | (F.coalesce(F.col("n_faulty").try_cast("int"), F.lit(0)) > 0)
    notes = _column(rows, "notes")
    order = F.monotonically_increasing_id()
    base = rows.select(
        _column(rows, "video").try_cast("int").alias("video_idx"), _column(rows, "frame_idx").try_cast("int").alias("frame_idx"),
        F.coalesce(verdict, F.lit(False)).alias("faulty"), (F.trim(notes) if notes is not None else F.lit("")).alias("notes"), order.alias("_o"),
    ).where("video_idx is not null and frame_idx is not null")
    joined = base.groupBy("video_idx", "frame_idx").agg(
        F.bool_or("faulty").alias("faulty"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("notes", F.lit("")) != "", F.struct("_o", "notes")))), lambda s: s["notes"]), "; ").alias("notes"),
    )
    return joined, faulty_only and instance is not None


def parse_keypoint_labels(rows: DataFrame) -> DataFrame:
    """(video_idx, frame_idx, inst_idx, bad), one row per reviewed instance."""
    return rows.select(
        _column(rows, "video").try_cast("int").alias("video_idx"), _column(rows, "frame_idx").try_cast("int").alias("frame_idx"),
        _column(rows, "instance").try_cast("int").alias("inst_idx"), bad_nodes(F.col("bad_keypoints")).alias("bad"),
    ).where("video_idx is not null and frame_idx is not null and inst_idx is not null")
