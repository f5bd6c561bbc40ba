"""Edits of poses: an append-only log folded up to a cursor, then joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posekeel.plans.pose_view import FRAME, KEY

#: steps that can be undone
HISTORY = 300


def effective_log(log: DataFrame, cursor: int | None = None) -> DataFrame:
    """Last state of each node up to the cursor from rows (key, node, seq, x, y,
    visible); undo is a smaller cursor."""
    rows = log if cursor is None else log.where(F.col("seq") <= cursor)
    last = rows.groupBy(*KEY, "node").agg(F.max_by(F.struct("x", "y", "visible"), "seq").alias("e"))
    return last.select(*KEY, "node", "e.*")


def apply_moves(instances: DataFrame, log: DataFrame, n: int, cursor: int | None = None) -> DataFrame:
    """Instances with moved, hidden and shown nodes."""
    e = effective_log(log, cursor)
    wide = e.groupBy(*KEY).agg(*[F.max(F.when(F.col("node") == k, F.struct("x", "y", "visible"))).alias(f"_e{k}") for k in range(n)])
    joined = instances.join(wide, list(KEY), "left")
    cols = {}
    for k in range(n):
        got = F.col(f"_e{k}")
        for a in "xy":
            cols[f"{a}{k}"] = F.when(got.isNull(), F.col(f"{a}{k}")).when(got["visible"], F.coalesce(got[a], F.col(f"{a}{k}")))
    return joined.withColumns(cols).drop(*[f"_e{k}" for k in range(n)])


def delete_instances(instances: DataFrame, gone: DataFrame) -> DataFrame:
    """Without some instances; those left in a frame are numbered anew."""
    left = instances.join(gone.select(*KEY), list(KEY), "left_anti")
    return left.withColumn("inst_idx", (F.row_number().over(Window.partitionBy(*FRAME).orderBy("inst_idx")) - 1).cast("int"))


def add_instances(instances: DataFrame, frames: DataFrame, videos: DataFrame, n: int) -> DataFrame:
    """A new instance in each given frame: nodes on a ring about the centre of
    the image, with 0.15 of its shorter side as radius."""
    last = instances.groupBy(*FRAME).agg((F.max("inst_idx") + 1).alias("_i"))
    side = F.least("width", "height") * 0.15
    step = 2 * 3.141592653589793 / n
    cols = [c for k in range(n) for c in ((F.col("width") / 2 + side * F.cos(F.lit(step * k))).alias(f"x{k}"), (F.col("height") / 2 + side * F.sin(F.lit(step * k))).alias(f"y{k}"))]
    new = frames.select(*FRAME).join(videos, "video_idx").join(last, list(FRAME), "left").select(*FRAME, F.coalesce("_i", F.lit(0)).cast("int").alias("inst_idx"), *cols)
    return instances.unionByName(new, allowMissingColumns=True)


def remove_node(instances: DataFrame, n: int, node: int) -> DataFrame:
    """Drop a node from every pose; later nodes move up."""
    kept = [k for k in range(n) if k != node]
    rest = [c for c in instances.columns if c not in {f"{a}{k}" for k in range(n) for a in "xyc"}]
    moved = [F.col(f"{a}{k}").alias(f"{a}{i}") for i, k in enumerate(kept) for a in "xyc" if f"{a}{k}" in instances.columns]
    return instances.select(*rest, *moved)


def append_node(instances: DataFrame, n: int) -> DataFrame:
    """A new last node, not visible anywhere."""
    return instances.withColumns({f"{a}{n}": F.lit(None).cast("double") for a in "xyc"})


def rename_node(names: list[str], node: int, name: str) -> list[str]:
    """Node names with one changed; an empty or taken name changes nothing."""
    name = name.strip()
    return names if not name or name in names else [name if i == node else n for i, n in enumerate(names)]


def add_edge(edges: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    return edges if a == b or (a, b) in edges or (b, a) in edges else [*edges, (a, b)]


def remove_edge(edges: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    return [e for e in edges if set(e) != {a, b}]


def trim_history(log: DataFrame) -> DataFrame:
    """The steps that can still be undone: the last ones by number."""
    top = log.agg(F.max("seq").alias("m")).first()["m"]
    return log if top is None else log.where(F.col("seq") > top - HISTORY)


def is_modified(log: DataFrame, saved: int) -> bool:
    """Whether there are edits after the saved step."""
    return not log.where(F.col("seq") > saved).isEmpty()
