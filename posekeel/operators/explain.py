"""Reasons: top issue, contributions, blame and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posekeel.skeleton import Skeleton

#: fixed values: divisor of features that are not z-scores
SCALE = {
    "max_centroid_distance": 30.0, "centroid_distance_std": 10.0, "nn_distance": 10.0, "max_curvature": 1.0, "curvature_std": 1.0,
    "visibility_rate": 0.3, "visibility_pattern_score": 0.3, "has_isolated_invisible": 0.3, "min_symmetry_consistency": 5.0,
}
#: fixed values: what a high feature is called
ISSUES = {
    "max_edge_zscore": "Unusual edge length", "mean_edge_zscore": "Unusual proportions", "max_angle_zscore": "Unusual joint angle",
    "mean_angle_zscore": "Unusual pose structure", "max_pairwise_zscore": "Unusual node spacing", "mean_pairwise_zscore": "Unusual scale",
    "bbox_area_zscore": "Unusual scale", "max_centroid_distance": "Isolated node", "centroid_distance_std": "Inconsistent spacing",
    "min_symmetry_consistency": "Likely L/R swap", "visibility_rate": "Unusual visibility", "has_isolated_invisible": "Isolated invisible node",
    "visibility_pattern_score": "Unusual visibility pattern", "nn_distance": "Unusual pose shape", "max_curvature": "Unusual curvature",
    "hull_area_zscore": "Unusual pose extent", "pose_split_score": "Split pose / chimera",
}
DIRECTED = ("max_edge_zscore", "max_angle_zscore", "max_pairwise_zscore", "bbox_area_zscore", "hull_area_zscore")
#: fixed values: precedence of the checks that say what is wrong
BLAME_ORDER = ("chirality", "ordering", "poseSplit", "feature", "anomaly", "gmm", "appearance", "outOfFrame", "confidence", "duplicates", "sparse", "instConfidence")
ISSUE_ORDER = ("chirality", "poseSplit", "ordering", "feature", "anomaly", "gmm", "appearance", "outOfFrame", "confidence", "duplicates", "sparse", "instConfidence")


def _scaled(feature: str) -> Column:
    value = F.col(feature) / SCALE.get(feature, 1.0)
    return F.when(F.col(feature) == 1.0, F.lit(0.0)).otherwise(value) if feature == "min_symmetry_consistency" else value


def top_issue(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds top_feature (largest scaled value, the first on ties) and top_issue."""
    parts = [F.struct(F.coalesce(_scaled(f), F.lit(float("-inf"))).alias("v"), F.lit(-i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(features)]
    best = F.array_max(F.array(*parts))["f"]
    names = F.create_map(*[F.lit(x) for f in features for x in (f, ISSUES.get(f, f"High {f}"))])
    return rows.withColumn("top_feature", best).withColumn("top_issue", names[F.col("top_feature")])


def confidence_word(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.5, "medium").otherwise("low")


def with_direction(issue: Column, direction: Column) -> Column:
    return F.when(direction > 0, F.concat(issue, F.lit(" (increased)"))).when(direction < 0, F.concat(issue, F.lit(" (decreased)"))).otherwise(issue)


def top_contributions(rows: DataFrame, features: Sequence[str], k: int = 3) -> DataFrame:
    """Adds top: the k largest features as (feature, value), first on ties."""
    parts = [F.struct(F.coalesce(F.col(f), F.lit(float("-inf"))).alias("value"), F.lit(-i).alias("order"), F.lit(f).alias("feature")) for i, f in enumerate(features)]
    return rows.withColumn("top", F.slice(F.sort_array(F.array(*parts), asc=False), 1, k))


def worst_edge(rows: DataFrame, s: Skeleton) -> DataFrame:
    """Adds blame_edge (kind, nodes, direction) of the most deviant edge, from
    the z_d_i_j columns; null if no edge is visible."""
    parts = []
    for i, (a, b) in enumerate(s.edges):
        z = F.col(f"z_d_{min(a, b)}_{max(a, b)}")
        parts.append(F.when(z.isNotNull(), F.struct(F.abs(z).alias("z"), F.lit(-i).alias("i"), F.array(F.lit(a), F.lit(b)).alias("nodes"), F.signum(z).cast("int").alias("direction"))))
    best = F.array_max(F.filter(F.array(*parts), lambda x: x.isNotNull()))
    return rows.withColumn("blame_edge", F.when(best.isNotNull(), F.struct(F.lit("edge").alias("kind"), best["nodes"].alias("nodes"), best["direction"].alias("direction"))))


def worst_angle(rows: DataFrame, s: Skeleton) -> DataFrame:
    parts = []
    for i, (c, a, b) in enumerate(s.angle_triplets()):
        z = F.col(f"z_a_{c}_{a}_{b}")
        parts.append(F.when(z.isNotNull(), F.struct(F.abs(z).alias("z"), F.lit(-i).alias("i"), F.array(F.lit(a), F.lit(c), F.lit(b)).alias("nodes"), F.signum(z).cast("int").alias("direction"))))
    best = F.array_max(F.filter(F.array(*parts), lambda x: x.isNotNull()))
    return rows.withColumn("blame_angle", F.when(best.isNotNull(), F.struct(F.lit("angle").alias("kind"), best["nodes"].alias("nodes"), best["direction"].alias("direction"))))


def worst_vertex(rows: DataFrame, chain: Sequence[int]) -> DataFrame:
    """Adds blame_vertex: the inner node of a chain at which it bends most, first
    on ties, from the k columns of its bends; null if it bends nowhere."""
    parts = [F.when(F.col(f"k{i}").isNotNull(), F.struct(F.abs(f"k{i}").alias("k"), F.lit(-i).alias("i"), F.lit(chain[i]).alias("node"))) for i in range(1, len(chain) - 1)]
    best = F.array_max(F.filter(F.array(*parts), lambda x: x.isNotNull())) if parts else F.lit(None).cast("struct<k: double, i: int, node: int>")
    return rows.withColumn("blame_vertex", best["node"])


def worst_visibility(rows: DataFrame, s: Skeleton, p: Mapping[str, float]) -> DataFrame:
    """Adds vis_node and vis_kind: the node most often blamed for a surprising
    absence or presence; -1 and null without one."""
    n = s.n_nodes
    blame = []
    for j in range(n):
        terms = [F.when((F.col(f"v{i}") == 1) & (((F.col(f"v{j}") == 0) & F.lit(p[f"p_{i}_{j}"] > 0.9)) | ((F.col(f"v{j}") == 1) & F.lit(p[f"p_{i}_{j}"] < 0.1))), 1).otherwise(0) for i in range(n) if i != j]
        blame.append(sum(terms[1:], terms[0]))
    parts = [F.struct(b.alias("c"), F.lit(-j).alias("j")) for j, b in enumerate(blame)]
    best = F.array_max(F.array(*parts))
    node = F.when(best["c"] > 0, -best["j"]).otherwise(F.lit(-1))
    kind = F.coalesce(*[F.when(node == j, F.when(F.col(f"v{j}") == 1, "present").otherwise("absent")) for j in range(n)])
    return rows.withColumns({"vis_node": node, "vis_kind": kind})


def first_reason(rows: DataFrame, flags: Mapping[str, str], name: str, order: Sequence[str] = BLAME_ORDER) -> DataFrame:
    """Adds the first check of the precedence whose flag column is set."""
    known = [F.when(F.col(flags[c]), F.lit(c)) for c in order if c in flags]
    return rows.withColumn(name, F.coalesce(*known) if known else F.lit(None).cast("string"))


def worst_instance(instances: DataFrame, limits: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """Worst instance of each frame: flagged ones first, then the largest margin
    over a limit relative to it, then the lowest number.  Null if no score is
    measured."""
    margins = [(F.col(s) - t) / F.lit(abs(t) or 1.0) for s, t in limits.items()]
    margin = F.greatest(*margins) if len(margins) > 1 else margins[0]
    ranked = instances.withColumn("_m", margin).where("_m is not null")
    best = ranked.groupBy(*keys).agg(F.max(F.struct((F.col("_m") >= 0).alias("flagged"), F.col("_m").alias("margin"), (-F.col("inst_idx")).alias("i"))).alias("b"))
    return best.select(*keys, (-F.col("b.i")).alias("worst_inst"), F.col("b.flagged").alias("worst_flagged"), F.col("b.margin").alias("worst_margin"))


def crop_box(rows: DataFrame, n: int, factor: float = 1.7, pad: float = 16.0) -> DataFrame:
    """Adds crop_x, crop_y, crop_side: a square about the placed nodes; null
    with fewer than two."""
    xs, ys = [F.col(f"x{k}") for k in range(n)], [F.col(f"y{k}") for k in range(n)]
    count = sum([F.when(x.isNotNull(), 1).otherwise(0) for x in xs[1:]], F.when(xs[0].isNotNull(), 1).otherwise(0))
    side = F.greatest(F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)) * factor + pad
    ok = count >= 2
    return rows.withColumns(
        {
            "crop_side": F.when(ok, side),
            "crop_x": F.when(ok, (F.greatest(*xs) + F.least(*xs)) / 2 - side / 2),
            "crop_y": F.when(ok, (F.greatest(*ys) + F.least(*ys)) / 2 - side / 2),
        }
    )


def node_patches(rows: DataFrame, n: int, share: float = 0.3, least: float = 24.0, keys: Sequence[str] = ()) -> DataFrame:
    """One row per placed node: its square patch, a share of the pose's larger
    side, ``least`` at least."""
    xs, ys = [F.col(f"x{k}") for k in range(n)], [F.col(f"y{k}") for k in range(n)]
    scale = F.greatest(F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys))
    side = F.greatest(F.lit(least), scale * share)
    nodes = F.array(*[F.struct(F.lit(k).alias("node"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate(zip(xs, ys))])
    return rows.withColumn("side", side).select(*keys, "side", F.inline(nodes)).where("x is not null and y is not null")


def seed_ghosts(rows: DataFrame, n: int, least: float = 18.0, share: float = 0.25) -> DataFrame:
    """Adds gx<k>, gy<k>: where an editor would show nodes that have no place,
    by golden angle about the centre of the placed ones; seen nodes keep theirs.
    They stay invisible to every check."""
    xs, ys = [F.col(f"x{k}") for k in range(n)], [F.col(f"y{k}") for k in range(n)]
    width, height = F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)
    radius = F.greatest(F.lit(least), F.sqrt(width * width + height * height) * share)
    cx, cy = (F.greatest(*xs) + F.least(*xs)) / 2, (F.greatest(*ys) + F.least(*ys)) / 2
    turn = 2.399963229728653
    return rows.withColumns({f"g{a}{k}": F.coalesce(F.col(f"{a}{k}"), c + radius * f(F.lit(turn * k))) for k in range(n) for a, c, f in (("x", cx, F.cos), ("y", cy, F.sin))})
