"""Frame-level checks.  Every aggregate starts from frames, so that frames
without instances keep their row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posekeel.config import QCConfig
from posekeel.functions.columns import finite, round_half_up
from posekeel.plans.pose_view import FRAME, Project


def node_columns(n: int, prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in range(n)]


def instance_facts(instances: DataFrame, n: int) -> DataFrame:
    """n_visible and confidences (least, its node, mean) of each instance."""
    c = node_columns(n, "c")
    count = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), 1).otherwise(0) for x in node_columns(n, "x")])
    scored = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), 1).otherwise(0) for x in c])
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in c])
    least = F.least(*c)
    node = F.coalesce(*[F.when(x == least, F.lit(k)) for k, x in enumerate(c)])
    return instances.withColumns(
        {"n_visible": count, "min_score": least, "min_node": node, "avg_score": F.when(scored > 0, total / F.when(scored > 0, scored).otherwise(1))}
    )


def frame_table(project: Project) -> DataFrame:
    """One row per frame: counts and the worst instance by each measure
    (the lowest number on ties)."""
    def worst(value: str) -> Column:
        return F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("inst_idx").alias("i"))))

    facts = instance_facts(project.instances, project.skeleton.n_nodes)
    per = facts.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("n_instances"),
        worst("n_visible").alias("sparse"),
        F.min(F.when(F.col("min_score").isNotNull(), F.struct(F.col("min_score").alias("v"), F.col("inst_idx").alias("i"), F.col("min_node").alias("n")))).alias("low"),
        worst("avg_score").alias("avg"),
        worst("inst_score").alias("inst"),
    )
    return project.frames.join(per, list(FRAME), "left").select(
        *FRAME, "is_negative",
        F.coalesce("n_instances", F.lit(0)).cast("long").alias("n_instances"),
        F.col("sparse.v").alias("min_visible"), F.col("sparse.i").alias("sparsest"),
        F.col("low.v").alias("min_score"), F.col("low.i").alias("low_instance"), F.col("low.n").alias("low_node"),
        F.col("avg.v").alias("avg_score"), F.col("avg.i").alias("avg_instance"),
        F.col("inst.v").alias("inst_score"), F.col("inst.i").alias("inst_instance"),
    )


def median_of_counts(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    """Median and mean of n over rows (by..., n, freq); freq is how often n
    occurs, so a video's rows here are its distinct counts."""
    return counts.groupBy(*by).agg(
        F.expr("percentile(n, 0.5, freq)").alias(name), (F.sum(F.col("n") * F.col("freq")) / F.sum("freq")).alias(f"{name}_mean")
    )


def expected_counts(frames: DataFrame) -> DataFrame:
    """Per video: expected (median of non-empty counts) and mean; a video with
    only empty frames takes the global values."""
    freq = frames.groupBy("video_idx", F.col("n_instances").alias("n")).agg(F.count(F.lit(1)).alias("freq"))
    filled = freq.where("n > 0")
    own = median_of_counts(filled, ["video_idx"], "own")
    whole = freq.groupBy("n").agg(F.sum("freq").alias("freq"))
    everything = median_of_counts(filled.groupBy("n").agg(F.sum("freq").alias("freq")), [], "all").crossJoin(median_of_counts(whole, [], "any"))
    videos = freq.select("video_idx").distinct().join(own, "video_idx", "left").crossJoin(everything)
    return videos.select("video_idx", F.coalesce("own", "all", "any").alias("expected_raw"), F.coalesce("own_mean", "all_mean", "any_mean").alias("mean_count"))


def count_check(frames: DataFrame) -> DataFrame:
    """Adds expected_count, mean_count and the three count flags; negative
    frames are exempt."""
    counts = frames.join(expected_counts(frames), "video_idx").withColumn("expected_count", round_half_up(F.col("expected_raw")).cast("long"))
    off = ~F.col("is_negative")
    return counts.withColumns(
        {
            "is_incomplete": off & (F.col("n_instances") < F.col("expected_count")),
            "is_overcount": off & (F.col("n_instances") > F.col("expected_count")),
            "is_wrong_count": off & (F.col("n_instances") != F.col("expected_count")),
            "is_empty": off & (F.col("n_instances") == 0),
        }
    ).drop("expected_raw")


def sparse_cutoff(project: Project, fraction: float) -> DataFrame:
    """One row: least visible nodes an instance should have; 2 without data."""
    facts = instance_facts(project.instances, project.skeleton.n_nodes)
    mean = F.avg("n_visible")
    return facts.agg(F.when(mean > 0, F.greatest(F.lit(1.0), round_half_up(mean * fraction))).otherwise(F.lit(2.0)).alias("sparse_cutoff"))


def duplicate_pairs(project: Project, config: QCConfig = QCConfig()) -> DataFrame:
    """Pairs of instances of one frame that overlap: boxes by IoU, else most of
    the nodes both have.  An equi-join on the frame, so bounded by its instances."""
    n = project.skeleton.n_nodes
    base = project.instances.select(*FRAME, "inst_idx", *[f"{a}{k}" for k in range(n) for a in "xy"])
    boxed = base.withColumns(
        {
            "n_visible": reduce(lambda a, b: a + b, [F.when(x.isNotNull(), 1).otherwise(0) for x in node_columns(n, "x")]),
            **{f"{op}{axis}": fn(*node_columns(n, axis)) for axis in "xy" for op, fn in (("lo", F.least), ("hi", F.greatest))},
        }
    )
    a = boxed.select(*FRAME, *[F.col(c).alias(f"a_{c}") for c in boxed.columns if c not in FRAME])
    b = boxed.select(*FRAME, *[F.col(c).alias(f"b_{c}") for c in boxed.columns if c not in FRAME])
    pairs = a.join(b, list(FRAME)).where("a_inst_idx < b_inst_idx")
    side = lambda axis: F.greatest(F.lit(0.0), F.least(f"a_hi{axis}", f"b_hi{axis}") - F.greatest(f"a_lo{axis}", f"b_lo{axis}"))
    area = lambda p: (F.col(f"{p}_hix") - F.col(f"{p}_lox")) * (F.col(f"{p}_hiy") - F.col(f"{p}_loy"))
    inter = side("x") * side("y")
    union = area("a") + area("b") - inter
    iou = F.when((F.col("a_n_visible") >= 2) & (F.col("b_n_visible") >= 2) & (union > 0), F.try_divide(inter, union)).otherwise(F.lit(0.0))
    gap = [F.sqrt(F.pow(F.col(f"a_x{k}") - F.col(f"b_x{k}"), 2) + F.pow(F.col(f"a_y{k}") - F.col(f"b_y{k}"), 2)) for k in range(n)]
    common = reduce(lambda s, g: s + g, [F.when(g.isNotNull(), 1).otherwise(0) for g in gap])
    near = reduce(lambda s, g: s + g, [F.when(g < config.duplicate_distance, 1).otherwise(0) for g in gap])
    found = pairs.withColumns({"iou": iou, "common": common, "near": near})
    reason = F.when(F.col("iou") > config.duplicate_iou, "iou").when((F.col("common") >= 2) & (F.col("near") > config.duplicate_ratio * F.col("common")), "node_overlap")
    return found.withColumn("reason", reason).where("reason is not null").select(*FRAME, F.col("a_inst_idx").alias("inst_a"), F.col("b_inst_idx").alias("inst_b"), "iou", "reason")


def out_of_frame(project: Project, margin: float = 0.0) -> DataFrame:
    """Instances with a node outside their video's image, and the first such
    node.  Videos without bounds report nothing."""
    bounds = project.videos.where("width is not null and height is not null").select("video_idx", "width", "height")
    joined = project.instances.join(bounds, "video_idx")
    tests = []
    for k in range(project.skeleton.n_nodes):
        x, y = finite(F.col(f"x{k}")), finite(F.col(f"y{k}"))
        outside = (x < -margin) | (x > F.col("width") + margin) | (y < -margin) | (y > F.col("height") + margin)
        tests.append(F.when(F.coalesce(outside, F.lit(False)), F.lit(k)))
    nodes = F.filter(F.array(*tests), lambda t: t.isNotNull())
    return joined.select(*FRAME, "inst_idx", nodes.alias("nodes")).where(F.size("nodes") > 0)


def frame_checks(project: Project, config: QCConfig = QCConfig()) -> DataFrame:
    """One row per frame with the facts and flags of all frame-level checks."""
    counted = count_check(frame_table(project))
    doubles = duplicate_pairs(project, config).groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("inst_a", "inst_b", "reason"))).alias("duplicates"))
    outside = out_of_frame(project, config.out_of_frame_margin).groupBy(*FRAME).agg(
        F.min(F.struct("inst_idx", F.element_at("nodes", 1).alias("node"))).alias("outside"), F.sum(F.size("nodes")).alias("n_outside")
    )
    joined = counted.join(doubles, list(FRAME), "left").join(outside, list(FRAME), "left").crossJoin(sparse_cutoff(project, config.sparse_fraction))
    confidence = F.col("avg_score") if config.confidence_mode == "avg" else F.col("min_score")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return joined.withColumns(
        {
            "is_sparse": flag(~F.col("is_negative") & (F.col("min_visible") < F.col("sparse_cutoff"))),
            "is_low_confidence": flag(confidence < config.confidence_threshold),
            "is_low_inst_confidence": flag(F.col("inst_score") < config.inst_confidence_threshold),
            "is_negative_with_instances": F.col("is_negative") & (F.col("n_instances") > 0),
            "has_duplicates": F.coalesce(F.size("duplicates") > 0, F.lit(False)),
            "is_out_of_frame": F.col("outside").isNotNull(),
        }
    )
