"""Flags, their union and overlaps, review queues and navigation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posekeel.config import SEVERITY
from posekeel.functions.ranks import sums_before, value_counts
from posekeel.plans.pose_view import FRAME

#: fixed values: weights of the ranking signals, of the node signal by its
#: scorer, the alarm percentile and the least p-value
WEIGHTS = {"anomaly": 2.2, "gmm": 2.4, "angle": 4.5, "mean_angle": 3.5, "node": 11.0}
NODE_WEIGHTS = {"svm": 26.4, "fewshot": 26.4, "patchBank": 11.0, "knn": 5.1}
PRIORITY_SCORERS = ("patchBank", "svm", "fewshot")
HOT, MIN_P = 0.95, 1e-4
#: scores that agree to so many decimals tie; above NEAR_ONE, where sums differ
#: by less than a score's last bit, only equal ones do
TIE_DECIMALS, NEAR_ONE = 11, 1 - 1e-6


def rollup_max(instances: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Largest value of each score per frame, and the instance that has it
    (the lowest number on ties).  Poses that are equal but for their place can
    differ in the last bits of a score; they tie, too."""
    scale = F.lit(10.0**TIE_DECIMALS)
    level = lambda v: F.when(v < NEAR_ONE, F.rint(v * scale) / scale).otherwise(v)
    worst = [F.max(F.struct(level(F.col(s).cast("double")).alias("v"), (-F.col("inst_idx")).alias("i"))).alias(f"_{s}") for s in scores]
    got = instances.groupBy(*FRAME).agg(*worst, *[F.max(s).alias(s) for s in scores])
    cols = [c for s in scores for c in (F.col(s), (-F.col(f"_{s}.i")).alias(f"{s}_inst"))]
    return got.select(*FRAME, *cols)


def flag_columns(rows: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """flag_<score> where a score reaches its limit; null is no flag."""
    return rows.withColumns({f"flag_{s}": F.coalesce(F.col(s) >= limit, F.lit(False)) for s, limit in limits.items()})


def any_of(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n) for n in names], F.lit(False))


def overlap_sizes(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows that each two detectors both flag (each with itself: its size).
    One pass; the result has as many rows as there are pairs."""
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i:]]
    counts = rows.agg(*[F.sum((F.col(a) & F.col(b)).cast("long")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    long = F.array(*[F.struct(F.lit(a).alias("detector_a"), F.lit(b).alias("detector_b"), F.coalesce(F.col(f"{i}"), F.lit(0)).alias("n")) for i, (a, b) in enumerate(pairs)])
    return counts.select(F.inline(long))


def exact_combinations(rows: DataFrame, flags: Sequence[str], top: int = 12) -> DataFrame:
    """The most frequent exact sets of detectors that flag a row."""
    some = rows.where(any_of(flags))
    return some.groupBy(*flags).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *[F.desc(f) for f in flags]).limit(top)


def unpivot_flags(rows: DataFrame, flags: Sequence[str], keys: Sequence[str] = FRAME) -> DataFrame:
    """(keys, detector, flagged), silent detectors included."""
    long = F.array(*[F.struct(F.lit(f.removeprefix("flag_")).alias("detector"), F.col(f).alias("flagged")) for f in flags])
    return rows.select(*keys, F.inline(long))


def review_queue(frames: DataFrame, scores: Mapping[str, float], flags: Sequence[str], order: str = "severity") -> DataFrame:
    """Flagged frames with severity (largest score over its limit, or fixed
    severity of a frame check) and number of detectors, in one of three orders."""
    parts = [F.when(F.col(s) >= limit, F.col(s)) for s, limit in scores.items()] + [F.when(F.col(f"flag_{k}"), F.lit(SEVERITY[k])) for k in flags]
    found = [F.coalesce(F.col(s) >= limit, F.lit(False)).cast("int") for s, limit in scores.items()] + [F.col(f"flag_{k}").cast("int") for k in flags]
    severity = F.greatest(*parts) if len(parts) > 1 else parts[0]
    queue = frames.withColumns({"severity": severity, "n_detectors": reduce(lambda a, b: a + b, found)}).where("severity is not null")
    keys = {"severity": [F.desc("severity")], "detectors": [F.desc("n_detectors"), F.desc("severity")], "frame": []}[order]
    return queue.orderBy(*keys, *FRAME)


def percentiles(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the share of measured rows with a smaller value; null stays null."""
    values = value_counts(rows.where(F.col(column).isNotNull()), column)
    total = values.agg(F.sum("_c").alias("n")).first()["n"] or 0
    ranks = sums_before(values, column, ["_c"]).select(column, (F.col("before__c") / F.lit(max(1, total - 1))).alias(name))
    return rows.join(ranks, column, "left")


def proofreading_queue(rows: DataFrame, keys: Sequence[str], signals: Sequence[str], scorer: str | None = None) -> DataFrame:
    """One row per instance: percentile of each signal, weighted Fisher evidence
    (unmeasured signals count as p = 0.5), number of alarmed detectors, the
    priority tier, the detector that speaks loudest, and the order's inputs.

    Sort by priority, evidence, agree (all falling), then the keys."""
    for s in signals:
        rows = percentiles(rows, s, f"pct_{s}")
    pct = {s: F.col(f"pct_{s}") for s in signals}
    weight = {**WEIGHTS, "node": NODE_WEIGHTS.get(scorer or "", WEIGHTS["node"])}
    p = {s: F.when(c.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(MIN_P), F.lit(1.0) - c)) for s, c in pct.items()}
    evidence = reduce(lambda a, b: a + b, [F.lit(-2.0 * weight[s]) * F.log(p[s]) for s in signals])
    hot = {s: F.coalesce(c >= HOT, F.lit(False)) for s, c in pct.items()}
    first = [s for s in signals if s == "angle" or s == "node" and scorer in PRIORITY_SCORERS]
    priority = reduce(lambda a, b: a | b, [hot[s] for s in first], F.lit(False))

    def loudest(pool: Sequence[str]) -> Column:
        best = F.greatest(*[F.coalesce(pct[s], F.lit(-1.0)) for s in pool]) if len(pool) > 1 else F.coalesce(pct[pool[0]], F.lit(-1.0))
        return F.coalesce(*[F.when(F.coalesce(pct[s], F.lit(-1.0)) == best, F.lit(s)) for s in pool])

    return rows.withColumns(
        {
            "evidence": evidence, "agree": reduce(lambda a, b: a + b, [hot[s].cast("int") for s in signals]), "priority": priority,
            "loudest": F.when(priority, loudest(first)).otherwise(loudest(signals)) if first else loudest(signals),
        }
    ).select(*keys, *[f"pct_{s}" for s in signals], "evidence", "agree", "priority", "loudest")


def queue_shape(queue: DataFrame, signals: Sequence[str]) -> DataFrame:
    """How many rows each signal alarms on, and how many agree 0, 1, 2, ... times."""
    hot = queue.agg(*[F.count_if(F.col(f"pct_{s}") >= HOT).alias(s) for s in signals])
    per = hot.select(F.inline(F.array(*[F.struct(F.lit("hot").alias("kind"), F.lit(s).alias("name"), F.col(s).alias("n")) for s in signals])))
    agree = queue.groupBy("agree").agg(F.count(F.lit(1)).alias("n")).select(F.lit("agree").alias("kind"), F.col("agree").cast("string").alias("name"), "n")
    return per.unionByName(agree)


def top_candidates(nodes: DataFrame, labelled: DataFrame, keys: Sequence[str], score: str, node: str, limit: int = 40) -> DataFrame:
    """Best node of each instance that has no label yet, the likeliest first."""
    best = nodes.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), F.col(node).alias("n"))).alias("b"))
    fresh = best.join(labelled.select(*keys), list(keys), "left_anti")
    return fresh.select(*keys, F.col("b.n").alias(node), F.col("b.s").alias(score)).orderBy(F.desc(score), *keys).limit(limit)


def timeline(frames: DataFrame, position: str, n: int, buckets: int, score: str, flag: str) -> DataFrame:
    """Worst score and any flag in each of ``buckets`` spans of n positions."""
    bucket = F.floor(F.col(position) * buckets / F.lit(n)).cast("long")
    return frames.groupBy(bucket.alias("bucket")).agg(F.max(score).alias("worst"), F.bool_or(flag).alias("flagged"))


def clamped_histogram(rows: DataFrame, value: str, threshold: float, bins: int = 26, low: float = -1.0) -> DataFrame:
    """Counts in equal bins from low to max(6, threshold + 2), ends clamped."""
    high = max(6.0, threshold + 2)
    place = F.floor((F.col(value) - low) / F.lit(high - low) * bins)
    return rows.groupBy(F.least(F.lit(bins - 1), F.greatest(F.lit(0), place)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: positions of a block: windows are over a block's rows, then over blocks
BLOCK_POSITIONS = 4096


def _beside(frames: DataFrame, hit: Column, group: str, order: str, forward: bool) -> DataFrame:
    """Adds _beside: the nearest position with a hit after (before) each row's
    in its group, round the end.  No task holds a group."""
    block = F.floor(F.col(order) / BLOCK_POSITIONS)
    pick, turn = (F.min, F.asc) if forward else (F.max, F.desc)
    marked = frames.withColumns({"_b": block, "_at": F.when(hit, F.col(order))})
    blocks = marked.groupBy(group, "_b").agg(pick("_at").alias("_p"))
    past = Window.partitionBy(group).orderBy(turn("_b")).rowsBetween(1, Window.unboundedFollowing)
    far = blocks.select(group, "_b", F.coalesce(pick("_p").over(past), pick("_p").over(Window.partitionBy(group))).alias("_far"))
    near = pick("_at").over(Window.partitionBy(group, "_b").orderBy(turn(order)).rowsBetween(1, Window.unboundedFollowing))
    same = F.col(group).eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_fb"))
    joined = marked.withColumn("_near", near).join(far.select(F.col(group).alias("_g"), F.col("_b").alias("_fb"), "_far"), same)
    return joined.withColumn("_beside", F.coalesce("_near", "_far")).drop("_b", "_at", "_near", "_g", "_fb", "_far")


def next_flagged(frames: DataFrame, flag: str, group: str, order: str) -> DataFrame:
    """For each frame the next flagged one of its group, round the end."""
    return _beside(frames, F.col(flag), group, order, True).withColumnRenamed("_beside", "next_flagged")


def previous_flagged(frames: DataFrame, flag: str, group: str, order: str) -> DataFrame:
    """For each frame the flagged one before it in its group, round the start."""
    return _beside(frames, F.col(flag), group, order, False).withColumnRenamed("_beside", "previous_flagged")


def neighbours_in(frames: DataFrame, wanted: Column, group: str, order: str) -> DataFrame:
    """Rows of a filtered list with the one before and after each in it, round
    both ends."""
    listed = frames.where(wanted)
    after = _beside(listed, F.lit(True), group, order, True).withColumnRenamed("_beside", "after")
    return _beside(after, F.lit(True), group, order, False).withColumnRenamed("_beside", "before")
