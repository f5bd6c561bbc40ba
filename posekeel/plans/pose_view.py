"""The canonical pose tables, and a pose view derived from orders and lineitem.

Frames are orders (video = key modulo 3), instances their line items, numbered
by a full order of their columns.  Six nodes form a chain; two pairs of names
are sided.  The arithmetic is polynomial and modular, so any engine agrees.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posekeel.llm.common import stash
from posekeel.skeleton import Skeleton

KEY = ("video_idx", "frame_idx", "inst_idx")
FRAME = KEY[:2]
WIDTH, HEIGHT = 560.0, 430.0

CHAIN = Skeleton(
    names=("nose", "neck", "ear_l", "ear_r", "hip", "tail"),
    edges=((0, 1), (1, 2), (2, 3), (3, 4), (4, 5)),
    pairs=((2, 3),),
)
N = CHAIN.n_nodes


@dataclass(frozen=True)
class Project:
    """One set of pose tables.  ``instances`` has the key, inst_score and
    x0, y0, c0, x1, ... (null where a node is not visible)."""

    videos: DataFrame
    frames: DataFrame
    instances: DataFrame
    skeleton: Skeleton


def unpack(instances: DataFrame, n_nodes: int) -> DataFrame:
    """Columns x0, y0, c0, ... from the stored points array; coordinates of
    invisible nodes, and ones that are not finite, are null."""
    cols = []
    for k in range(n_nodes):
        p = F.get("points", k)
        for name, part in (("x", "x"), ("y", "y"), ("c", "score")):
            v = p[part]
            cols.append(F.when(p["visible"] & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v).alias(f"{name}{k}"))
    return instances.select(*KEY, "track", "inst_score", *cols)


def derived(spark: SparkSession, sf_dir: str) -> Project:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    key = F.col("o_orderkey")
    frames = orders.select((key % 3).cast("int").alias("video_idx"), key.alias("frame_idx"), (key % 41 == 0).alias("is_negative"))
    o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")) - 1
    cols = []
    for k in range(N):
        seen = (o + p * (k + 1)) % 17 != 0
        x = (p * 37) % 500 + 10 * k + ((o * (k + 3) + n * 7) % 11) * 0.25
        if k == N - 1:
            x = x + F.when(o % 97 == 0, 80.0).otherwise(0.0)
        y = (p * 53) % 400 + ((p * (k + 5) + n) % 13) * 0.25
        c = ((p * (k + 2) + n * 5) % 100) / 100.0
        cols += [F.when(seen, v.cast("double")).alias(f"{name}{k}") for name, v in (("x", x), ("y", y), ("c", c))]
    instances = lines.select(
        (o % 3).cast("int").alias("video_idx"), o.alias("frame_idx"), number.cast("int").alias("inst_idx"),
        F.when(s % 4 != 0, (s * 7 + n * 11) % 100 / 100.0).alias("inst_score"), *cols,
    )
    videos = spark.range(3).select(F.col("id").cast("int").alias("video_idx"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    return Project(videos, frames, instances, CHAIN)


def held(project: Project) -> Project:
    """The same with instances as a work table: passes over a derived view would
    each shuffle its source anew.  What that one shuffle wrote goes at once."""
    spark, name = project.instances.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        return replace(project, instances=stash(project.instances))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _node_sql(k: int) -> str:
    seen = f"(l_orderkey + l_partkey * {k + 1}) % 17 <> 0"
    x = f"(l_partkey * 37) % 500 + {10 * k} + ((l_orderkey * {k + 3} + l_linenumber * 7) % 11) * 0.25"
    if k == N - 1:
        x += " + CASE WHEN l_orderkey % 97 = 0 THEN 80.0 ELSE 0.0 END"
    y = f"(l_partkey * 53) % 400 + ((l_partkey * {k + 5} + l_linenumber) % 13) * 0.25"
    c = f"((l_partkey * {k + 2} + l_linenumber * 5) % 100) / 100.0"
    return ", ".join(f"CASE WHEN {seen} THEN CAST({v} AS DOUBLE) END AS {n}{k}" for n, v in (("x", x), ("y", y), ("c", c)))


FRAMES_SQL = "(SELECT CAST(o_orderkey % 3 AS INTEGER) AS video_idx, o_orderkey AS frame_idx, o_orderkey % 41 = 0 AS is_negative FROM orders)"
INSTANCES_SQL = (
    "(SELECT CAST(l_orderkey % 3 AS INTEGER) AS video_idx, l_orderkey AS frame_idx, CAST(row_number() OVER (PARTITION BY l_orderkey"
    " ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS INTEGER) AS inst_idx,"
    " CASE WHEN l_suppkey % 4 <> 0 THEN CAST((l_suppkey * 7 + l_linenumber * 11) % 100 / 100.0 AS DOUBLE) END AS inst_score, "
    + ", ".join(_node_sql(k) for k in range(N)) + " FROM lineitem)"
)
