"""Agreement of flags with human judgements, and ranking quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posekeel.functions.ranks import sums_before


def confusion(rows: DataFrame, flag: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy and Cohen's kappa; a
    ratio without cases is 0."""
    f, t = F.coalesce(F.col(flag), F.lit(False)), F.coalesce(F.col(truth), F.lit(False))
    counts = {"tp": f & t, "fp": f & ~t, "fn": ~f & t, "tn": ~f & ~t}
    return rates(rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()]))


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = tp + fp + fn + tn
    chance = share((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    accuracy = share(tp + tn, n)
    return counts.withColumns(
        {
            "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "accuracy": accuracy,
            "kappa": share(accuracy - chance, F.lit(1.0) - chance),
        }
    )


def detector_f1(rows: DataFrame, flags: Sequence[str], truth: str) -> DataFrame:
    """F1 of each detector, best first."""
    long = F.array(*[F.struct(F.lit(f).alias("detector"), F.col(f).alias("flagged")) for f in flags])
    return confusion(rows.select(F.col(truth).alias("truth"), F.inline(long)), "flagged", "truth", ["detector"]).orderBy(F.desc("f1"), "detector")


def against_review(frames: DataFrame, review: DataFrame, flag: str, faulty_only: bool, keys: Sequence[str]) -> DataFrame:
    """Frames with their human verdict.  A file that lists only faulty frames
    makes the others clean; otherwise frames it does not list are left out."""
    joined = frames.join(review.select(*keys, "faulty"), list(keys), "left" if faulty_only else "inner")
    return joined.withColumn("faulty", F.coalesce("faulty", F.lit(False)))


def unmatched_review(frames: DataFrame, review: DataFrame, keys: Sequence[str]) -> DataFrame:
    return review.join(frames, list(keys), "left_anti")


def _by_value(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    return rows.groupBy(F.col(score).alias("s")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))


def roc_auc(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the curve by ranks, ties averaged; null with one class only.
    Sums run over distinct scores."""
    counts = sums_before(_by_value(rows, score, F.col(truth)), "s", ["n"])
    wins = counts.select("p", "n", (F.col("p") * (F.col("before_n") + F.col("n") / 2)).alias("w"))
    return wins.agg(F.try_divide(F.sum("w"), F.sum("p").cast("double") * F.sum("n")).alias("roc_auc"))


def average_precision(rows: DataFrame, score: str, truth: str, order: str) -> DataFrame:
    """Mean precision at each true row, from the highest score down; ties go
    by the order column.

    Ranks are offsets of the score's group plus the place inside it."""
    counts = sums_before(_by_value(rows, score, F.col(truth)).withColumn("c", F.col("p") + F.col("n")), "s", ["p", "c"], descending=True)
    starts = counts.select("s", F.col("before_p").alias("p0"), F.col("before_c").alias("c0"))
    inside = Window.partitionBy(score).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select(score, truth, order).withColumns({"hits": F.sum(F.col(truth).cast("long")).over(inside), "place": F.count(F.lit(1)).over(inside)})
    joined = placed.where(truth).join(starts, F.col(score) == F.col("s"))
    return joined.agg(F.avg((F.col("p0") + F.col("hits")) / (F.col("c0") + F.col("place"))).alias("average_precision"))
