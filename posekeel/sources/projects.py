"""A pose project: one folder of Parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posekeel.plans.pose_view import Project, unpack
from posekeel.skeleton import Skeleton

#: fixed value: names of pose files that an importer takes
POSE_FILE = re.compile(r"\.(pkg\.)?slp$", re.IGNORECASE)

SCHEMAS = {
    "videos": "video_idx int, filename string, n_frames int, height int, width int, channels int",
    "frames": "video_idx int, frame_idx int, is_negative boolean",
    "instances": "video_idx int, frame_idx int, inst_idx int, track string, inst_score double, points array<struct<x:double,y:double,visible:boolean,score:double>>",
    "skeleton_nodes": "node int, name string",
    "skeleton_edges": "source int, destination int",
    "skeleton_symmetries": "left int, right int",
}


def is_pose_file(name: str) -> bool:
    return bool(POSE_FILE.search(name))


def read_project(spark: SparkSession, path: str) -> Project:
    """Load the tables; a video is known by its number, not its name.  Frames
    without a number are left out, frames without instances are not."""
    table = {name: spark.read.schema(schema).parquet(f"{path}/{name}.parquet") for name, schema in SCHEMAS.items()}
    names = [r["name"] for r in table["skeleton_nodes"].orderBy("node").collect()]
    edges = [tuple(r) for r in table["skeleton_edges"].collect()]
    pairs = sorted(tuple(sorted(r)) for r in table["skeleton_symmetries"].collect())
    skeleton = Skeleton(tuple(names), tuple(edges), tuple(pairs))
    frames = table["frames"].where("frame_idx is not null").withColumn("is_negative", F.coalesce("is_negative", F.lit(False)))
    return Project(table["videos"], frames, unpack(table["instances"], skeleton.n_nodes), skeleton)


def totals(project: Project) -> DataFrame:
    """One row: videos, frames, instances and tracks."""
    tracks = F.countDistinct("track") if "track" in project.instances.columns else F.lit(0)
    counts = project.instances.agg(F.count(F.lit(1)).alias("instances"), tracks.alias("tracks"))
    return project.videos.agg(F.count(F.lit(1)).alias("videos")).crossJoin(project.frames.agg(F.count(F.lit(1)).alias("frames"))).crossJoin(counts)


def read_node_embeddings(spark: SparkSession, path: str, file_id: str | None = None) -> DataFrame:
    """Cached embeddings, partitioned by file; one file reads its folder only."""
    df = spark.read.parquet(path)
    return df if file_id is None else df.where(F.col("file_id") == file_id)

